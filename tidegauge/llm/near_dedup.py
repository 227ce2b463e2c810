"""Near-duplicate texts by BK-trees over SimHash fingerprints and exact resemblance (operator 6 at 0.8; the pipeline's second stage).

Two texts are linked when their sets of five-word shingles have a resemblance
(shared over all shingles) of at least ``LEAST``; linked texts form components.

Shards. SimHash bits of texts at 0.8 differ so often (about 39 of 256) that
bands of them would have to be short and many, and shards would grow with the
square of the corpus. A shard is therefore dealt by the text's shingles: a set has
``BANDS`` keys, each of ``ROWS`` independent least hashes, so two sets of
resemblance r share a key with probability ``1 - (1 - r**ROWS)**BANDS``: 0.9993
at 0.8, 0.99999 at 0.85. Of shards with the same members one is searched. Equal
sets are one member.

Search, as in ``simhash``: a task builds the BK-tree of a shard's ``PRINT_WORDS``
* 64 bit SimHash fingerprints and searches it with every member, following only
edges within ``RADIUS``. The radius is wide: at 0.8 a pair of long texts
differs in 39 bits with a deviation of 6, one of five and four shingles in 48
with a deviation of 6. What the tree finds is confirmed by counting the two
sets' common shingles exactly, so a link is never an estimate. Members that the
shard has connected already are not confirmed again; links leave as a spanning
forest. A shard of more than ``HOT_SHARD`` members is cut into blocks, and every
pair of blocks is searched as a shard of its own: no pair is left out at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_arrow, materialise, packed, ref, slices, text_or_empty, unpacked
from tidegauge.llm.simhash import BkTree, Fingerprints, Forest, block_pairs, components, mix

SHINGLE = 5
LEAST = 0.8
ROWS = 6
BANDS = 24
#: Members above which a shard is searched in pairs of blocks.
HOT_SHARD = 1_024
PRINT_WORDS = 4
RADIUS = 72
#: Candidates confirmed at once.
AT_ONCE = 16
#: Shingles hashed at once.
CHUNK = 512

_SALT = np.random.default_rng(42).integers(0, 1 << 32, (2, ROWS * BANDS), dtype=np.uint32)


def shingle_set(of: Fingerprints, text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(of.hashes(text))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of each of ROWS * BANDS hashes of a set."""
    h, out = hashes.astype(np.uint32), np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), CHUNK):
        np.minimum(out, ((h[at : at + CHUNK, None] ^ _SALT[0]) * (_SALT[1] | np.uint32(1))).min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """Keys of the rows of ``least``, one for each band."""
    parts = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for n in range(ROWS):
        keys = mix(keys ^ parts[:, :, n], n + 1)
    return keys


def set_print(of: Fingerprints, hashes: np.ndarray) -> bytes:
    """The SimHash fingerprint of a set."""
    return b"".join([w.to_bytes(8, "little") for w in of.of_hashes(hashes)])


def resembling(prints: list[bytes], sets: list[np.ndarray], least: float = LEAST, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of places whose sets resemble each other by ``least`` or more, found by a BK-tree over their fingerprints."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), np.int32)
    forest, tree = Forest(len(sets)), BkTree()
    for i, p in enumerate(prints):
        own = codes[starts[i] : starts[i + 1]]
        near = [j for j in tree.add_and_search(int.from_bytes(p, "little"), radius) if sizes[i] >= least * sizes[j] - 1e-9 and sizes[j] >= least * sizes[i] - 1e-9]
        mark[own] = 1
        while near:
            part, near = np.array(near[:AT_ONCE]), near[AT_ONCE:]
            both = np.add.reduceat(mark[np.concatenate([codes[starts[j] : starts[j + 1]] for j in part])], np.r_[0, np.cumsum(sizes[part])[:-1]])
            hit = both >= least * (sizes[i] + sizes[part] - both) - 1e-9
            for j in part[hit].tolist():
                if forest.join(i, j):
                    yield j, i
            if hit.any():
                at = forest.root(i)
                near = [j for j in near if forest.root(j) != at]
        mark[own] = 0


def keyed_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, tk, sid, keys) of rows (doc_id, tk, text): the set's id and its band keys (none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprints(shingle)
        for batch in slices(batches):
            sets = [shingle_set(of, t) for t in batch.column(2).to_pylist()]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = band_keys(np.stack([least_hashes(s) for s in sets])).view(np.int64)
            full = np.array([len(s) > 0 for s in sets])
            at = pa.array(np.r_[0, np.cumsum(full * BANDS)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sid), pa.ListArray.from_arrays(at, pa.array(keys[full].ravel()))], names=["doc_id", "tk", "sid", "keys"])

    return map_arrow(docs.select("doc_id", "tk", "text"), run, "doc_id long, tk long, sid long, keys array<long>")


def packed_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(sid, print, held) of rows (sid, text): the fingerprint and the shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprints(shingle, PRINT_WORDS)
        for batch in slices(batches):
            sets = [shingle_set(of, t) for t in batch.column(1).to_pylist()]
            prints = [set_print(of, s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "print", "held"])

    return map_arrow(texts.select("sid", "text"), run, "sid long, print binary, held binary")


def search(members: DataFrame, least: float) -> DataFrame:
    """Links (u, v) among rows (s1, s2, sid, print, held) that share (s1, s2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by shard; a shard may span batches.
        shard, ids, prints, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            found = list(resembling(prints, sets, least)) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for s1, s2, sid, print_, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s1, s2) != shard:
                    if (found := links()).num_rows:
                        yield found
                    shard, ids, prints, sets = (s1, s2), [], [], []
                ids.append(sid)
                prints.append(print_)
                sets.append(np.frombuffer(held, np.uint64))
        if (found := links()).num_rows:
            yield found

    rows = members.select("s1", "s2", "sid", "print", "held").repartition("s1", "s2").sortWithinPartitions("s1", "s2", "sid")
    return map_arrow(rows, run, "u long, v long")


def set_links(distinct: DataFrame, texts: DataFrame, shingle: int, least: float, hot_shard: int) -> DataFrame:
    """Links (u, v) among the sets of ``distinct`` (sid, row, keys); ``texts`` has the rows (doc_id, tk, text) that ``row`` names."""
    keyed = distinct.select("sid", F.explode("keys").alias("s1"))
    shards = keyed.groupBy("s1").agg(F.count("*").alias("n"), F.bit_xor("sid").alias("x"), F.bit_xor(F.xxhash64("sid")).alias("y")).filter("n > 1")
    once = shards.groupBy("n", "x", "y").agg(F.min("s1").alias("s1")).select("s1", "n")
    members = materialise(keyed.join(once.hint("merge"), "s1"), "members")
    wanted = distinct.join(members.select("sid").distinct().hint("merge"), "sid", "left_semi").select("sid", F.col("row.doc_id").alias("_id"), F.col("row.tk").alias("_tk"))
    found = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))).select("sid", "text")
    held = packed_sets(found, shingle).dropDuplicates(["sid"])
    dealt = members.join(held.hint("merge"), "sid").select("s1", F.explode(block_pairs(F.col("sid"), F.col("n"), hot_shard)).alias("s2"), "sid", "print", "held")
    return search(dealt, least)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, hot_shard: int = HOT_SHARD) -> DataFrame:
    """(doc_id, tk, component) of each row of ``docs`` (doc_id, tk, text): the component is named by one of its sets."""
    prints = materialise(keyed_sets(docs, shingle), "sets")
    distinct = materialise(prints.groupBy("sid").agg(F.min(F.struct("doc_id", "tk")).alias("row"), F.first("keys").alias("keys")), "distinct")
    roots = components(materialise(set_links(distinct, docs, shingle, least, hot_shard), "links"))
    named = roots.select(F.col("fid").alias("sid"), "root")
    return prints.join(named.hint("merge"), "sid", "left").select("doc_id", "tk", F.coalesce("root", "sid").alias("component"))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, hot_shard: int = HOT_SHARD) -> DataFrame:
    """The columns of ``docs``, with one row, that of the least id, of each group of near duplicates.

    Rows without an id cannot be named and stay. Rows are told apart by id and
    text: of rows that repeat both one stays, and of different texts with one
    id each is kept or removed by its own group.
    """
    rows = docs.select(packed(docs.columns).alias("row"), ref("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty("text")).alias("tk"))
    texts = docs.select(ref("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty("text")).alias("tk"), text_or_empty("text").alias("text"))
    groups = materialise(near_duplicates(texts, shingle, least, hot_shard).filter("doc_id IS NOT NULL"), "groups")
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "tk")).alias("first"))
    lost = groups.join(first.hint("merge"), "component").filter("doc_id <> first.doc_id OR tk <> first.tk").select("doc_id", "tk")
    repeated = groups.groupBy("doc_id", "tk").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "tk")
    # A merge join at every size: the list of lost rows grows with the corpus, so it is not broadcast.
    kept = rows.join(lost.distinct().hint("merge"), ["doc_id", "tk"], "left_anti")
    if repeated.take(1):
        once = kept.join(repeated, ["doc_id", "tk"], "left_semi").dropDuplicates(["doc_id", "tk"])
        kept = kept.join(repeated, ["doc_id", "tk"], "left_anti").unionByName(once.select(kept.columns))
    return kept.select(unpacked(docs.columns))
