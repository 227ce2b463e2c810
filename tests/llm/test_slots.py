"""Operator 12: sizes, checksums, places without gaps, balance, maps edited slot by slot."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import slots


def plain(rows):
    """(doc_id, size, checksum) of rows (doc_id, text)."""
    return Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)


def check_places(rows, n_shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(0 <= s < n_shards for s in by_shard)
    assert all(sorted(found) == list(range(len(found))) for found in by_shard.values())


def test_every_row_once_without_gaps(spark, docs, texts):
    rows = slots.sharded(docs, 5, 64).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == plain(texts)
    check_places(rows, 5)


def test_a_query_row_has_the_contract_columns(spark, mini, texts):
    df = slots.op12_virtual_slots(spark, mini)
    kinds = dict(df.dtypes)
    assert [kinds[c] for c in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]
    rows = df.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == plain(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_one_record_that_is_a_third_of_the_table_is_spread(spark):
    docs = spark.range(2_000).select(F.when(F.col("id") < 700, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 700, "same text " * 20).otherwise(F.repeat(F.lit("x"), (F.col("id") % 400).cast("int"))).alias("text"))
    rows = slots.sharded(docs, 24, 512).collect()
    check_places(rows, 24)
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert len(size) == 24 and max(size.values()) - min(size.values()) <= 408
    assert max(Counter(r.virtual_slot for r in rows if r.doc_id == 7).values()) <= 2


def test_shards_of_the_test_data_are_nearly_equal(spark, sf_dir):
    sizes = [(r.shard, r.size) for r in slots.op12_virtual_slots(spark, sf_dir).collect()]
    load = Counter()
    for shard, size in sizes:
        load[shard] += size
    mean, greatest = sum(load.values()) / 24, max(s for _, s in sizes)
    assert len(load) == 24 and max(load.values()) <= max(greatest, 1.01 * mean)


def test_partitions_do_not_change_the_result(spark, docs):
    both = [sorted(map(tuple, slots.sharded(d, 5, 64).collect()), key=str) for d in (docs, docs.repartition(7))]
    assert both[0] == both[1]


def test_rebalancing_ends_where_no_move_or_swap_helps():
    for seed in range(20):
        r = random.Random(seed)
        weight = [int(r.paretovariate(1.1) * 10) if r.random() < 0.7 else 0 for _ in range(60)]
        before = slots.first_map(60, 4)
        after = slots.rebalanced(before, weight, 4)
        load = [sum(w for w, s in zip(weight, after) if s == k) for k in range(4)]
        low = load.index(min(load))
        for a in range(60):
            gap = load[after[a]] - load[low]
            for change in [weight[a], *(weight[a] - weight[b] for b in range(60) if after[b] == low)]:
                assert after[a] == low or not 0 < change < gap
        assert all(x == y for x, y, w in zip(before, after, weight) if not w)


def test_growing_moves_slots_to_the_new_shard_alone():
    r = random.Random(3)
    weight = [r.randint(0, 1000) for _ in range(400)]
    before = slots.rebalanced(slots.first_map(400, 8), weight, 8)
    after = slots.grown(before, weight, 8)
    assert {y for x, y in zip(before, after) if x != y} == {8}
    load = [sum(w for w, s in zip(weight, after) if s == k) for k in range(9)]
    assert max(load) - min(load) < 0.05 * sum(weight) / 9


def test_versions_of_a_map_are_kept(spark, docs, tmp_path):
    path = f"{tmp_path}/maps"
    first = slots.first_map(64, 3)
    slots.store_map(spark, path, 0, first)
    rows = slots.sharded(docs, 3, 64, maps=path).collect()
    assert {r.map_version for r in rows} == {1}
    assert [r.shard for r in slots.load_map(spark, path, 0).orderBy("virtual_slot").collect()] == first
    newest = {r.virtual_slot: r.shard for r in slots.load_map(spark, path).collect()}
    assert len(newest) == 64 and all(newest[r.virtual_slot] == r.shard for r in rows)
    with pytest.raises(Exception, match="(?i)exist"):
        slots.store_map(spark, path, 1, first)


def test_empty_table_and_clashing_columns(spark, empty, docs, texts):
    assert slots.sharded(empty).collect() == []
    named = docs.withColumns({c: F.lit(1) for c in ("size", "n", "k", "copies", "virtual_slot", "shard", "first", "_id", "a.b", "N-chars")})
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in slots.sharded(named, 3, 16).collect()) == plain(texts)
