"""Sharding by fixed virtual slots (operator 12). Native: DataFrame functions only.

A record is hashed by its id, its text and its number among equal records into
one of ``SLOTS`` virtual slots, whose number never changes. Bytes are summed by
slot, and a slot-to-shard map of ``SLOTS`` numbers says where each slot lies.
Maps are versions of one stored table: a first map deals slots out in ranges,
and rebalancing or growing edits the slots that move and stores the next version.

The law kept is ``bytes``: ``rebalanced`` moves or swaps slots between a heavy
and the lightest shard for as long as that brings their sizes closer, so that
at the end two shards differ by less than the least slot that could still move.
A document of more than its shard's share stays whole.

Equal records are one row with a count until the last step, and their copies
are dealt round the slots, so no slot holds a third of the table because one
record does. Only the slots' sums reach the driver, ``SLOTS`` rows at most.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import materialise, shared_dir, table, text_or_empty

SLOTS = 8_192
SHARDS = 24
#: Bytes that a record takes besides its text.
FIXED_BYTES = 8


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, doc_id, size, text_crc32, copies): equal records of one slot are one row.

    The copies of a record are dealt round all slots from the one that its hash names.
    """
    text = F.encode(text_or_empty(F.col("text")), "UTF-8")
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + FIXED_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    equal = records.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(slots)) - 1)).alias("k")
    dealt = equal.select("*", turn)
    return dealt.select(
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32") + F.col("k"), F.lit(slots)).cast("int").alias("virtual_slot"), "doc_id", "size", "text_crc32",
        (F.floor((F.col("n") - 1 - F.col("k")) / slots) + 1).alias("copies"))


def slot_sums(records: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of the slots that hold records."""
    return records.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


def first_map(slots: int, shards: int) -> list[int]:
    """The shard of each slot, in ranges."""
    return [slot * shards // slots for slot in range(slots)]


def _exchange(heavy: list[tuple[int, int]], light: list[tuple[int, int]], gap: int) -> tuple[int, tuple[int, int], tuple[int, int] | None] | None:
    """What to move from a heavy shard, and what to take back for it, so that the gap shrinks most: both are sorted (bytes, slot)."""
    found = None
    for back in [None, *light]:
        base = back[0] if back else 0
        at = bisect_left(heavy, (base + gap // 2, -1))
        for one in heavy[max(at - 1, 0) : at + 1]:
            left = abs(gap - 2 * (one[0] - base))
            if left < gap and (found is None or left < found[0]):
                found = left, one, back
        if found and found[0] <= 1:
            break
    return found


def rebalanced(shard_of: Sequence[int], weight: Sequence[int], shards: int) -> list[int]:
    """The map edited until no move or swap between a shard and the lightest one brings their bytes closer."""
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        if weight[slot]:
            held[shard].append((weight[slot], slot))
    for one in held:
        one.sort()
    load, edited = [sum(w for w, _ in one) for one in held], list(shard_of)
    while True:
        order = sorted(range(shards), key=lambda s: (-load[s], s))
        low = order[-1]
        for high in order[:-1]:
            found = _exchange(held[high], held[low], load[high] - load[low])
            if found:
                break
        else:
            return edited
        _, out, back = found
        for one, source, target in ((out, high, low), (back, low, high)):
            if one:
                held[source].remove(one)
                insort(held[target], one)
                load[source] -= one[0]
                load[target] += one[0]
                edited[one[1]] = target


def grown(shard_of: Sequence[int], weight: Sequence[int], shards: int) -> list[int]:
    """The map with one more shard, number ``shards``, that takes slots from the heaviest ones up to its share; no other slot moves."""
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        insort(held[shard], (weight[slot], slot))
    load, edited, new, share = [sum(w for w, _ in one) for one in held], list(shard_of), 0, sum(weight) / (shards + 1)
    while True:
        for high in sorted(range(shards), key=lambda s: (-load[s], s)):
            at = bisect_left(held[high], (share - new, 1 << 62)) - 1
            if at >= 0 and held[high][at][0]:
                size, slot = held[high].pop(at)
                load[high], new, edited[slot] = load[high] - size, new + size, shards
                break
        else:
            return edited


def store_map(spark: SparkSession, path: str, version: int, shard_of: Sequence[int]) -> None:
    """Store a map as a version of the table at ``path``. A version is never written twice: that is an error."""
    numbers = F.posexplode(F.split(F.lit(",".join(map(str, shard_of))), ",")).alias("virtual_slot", "shard")
    spark.range(1).select(numbers).select("virtual_slot", F.col("shard").cast("int").alias("shard")).coalesce(1).write.parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard, version) of a version, the newest unless given."""
    stored = spark.read.schema("virtual_slot int, shard int, version long").parquet(path)
    if version is None:
        version = stored.agg(F.max("version").alias("v")).first().v
    return stored.filter(F.col("version") == F.lit(version))


def weights(sums: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each slot; there are ``slots`` of them whatever the table."""
    found = [0] * slots
    for row in sums.collect():
        found[row.virtual_slot] = row.bytes
    return found


def placed(records: DataFrame, sums: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record with its shard and its place there: slots in turn, and records by id, size and checksum within a slot."""
    layout = slot_map.join(sums, "virtual_slot")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    layout = layout.select("virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(before, F.lit(0)).alias("first"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    # The map has one row a slot, SLOTS in all.
    known = records.withColumn("earlier", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(F.broadcast(layout), "virtual_slot")
    start = F.col("first") + F.col("earlier")
    return known.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(start, start + F.col("copies") - 1)).alias("slot"), "virtual_slot", "map_version")


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard, from 0 without gaps), virtual_slot and map_version of every row of ``docs``.

    ``maps`` is the folder of the map's versions (a new one in the shared folder
    unless given): version 0 is the first map, version 1 its edit by this
    table's bytes; where the folder has versions, the newest is edited.

    Null texts count as empty (checksum 0), null ids are ids, equal rows are
    spread over slots, an empty table gives an empty result, other columns are
    ignored. Equal texts under different ids are dealt apart.
    """
    spark = docs.sparkSession
    records = materialise(slotted(docs, slots), "slotted")
    sums = materialise(slot_sums(records), "slot-sums")
    if maps is None:
        maps, version, held = f"{shared_dir(spark)}/slot-map-{uuid4().hex}", 0, first_map(slots, shards)
        store_map(spark, maps, version, held)
    else:
        rows = load_map(spark, maps).collect()
        version, held = rows[0].version, [r.shard for r in sorted(rows, key=lambda r: r.virtual_slot)]
    store_map(spark, maps, version + 1, rebalanced(held, weights(sums, slots), shards))
    return placed(records, sums, load_map(spark, maps, version + 1))


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
