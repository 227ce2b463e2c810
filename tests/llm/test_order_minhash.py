"""Operator 9: edited texts and the next document by brute force, what the fingerprints mean."""

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidegauge.llm import order_minhash as om


def prints(spark, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    return [r[0] for r in df.select("n", om.fingerprint(F.col("text")).alias("f")).orderBy("n").select("f").collect()]


def like(a, b):
    return sum(a[i : i + om.HEX] == b[i : i + om.HEX] for i in range(0, len(a), om.HEX)) / om.SIGNATURES


def check_rows(docs, rows):
    """Edited texts and likenesses of rows that stand in the order of ``docs``."""
    for at, d in enumerate(docs):
        other = docs[(at + 1) % len(docs)]
        cut = len(d.text) // 3
        edited = d.text[: len(d.text) - cut] + other.text[:cut]
        r = rows[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(d.text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == like(r.fingerprint, rows[other.doc_id].fingerprint) and r.near_edited == like(r.fingerprint, r.edited_fingerprint)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ordered = sorted(docs.collect(), key=lambda r: -r.doc_id)
    for found in (om.op9_order_minhash(spark, sf_dir), om.edit_likeness(docs, bucket_rows=20)):
        check_rows(ordered, {r.doc_id: r for r in found.collect()})


def test_next_in_buckets(spark):
    ids = [5, 900, 17, 3, 3, 250_000, -40, None, None, 18]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "k long, text string")
    order = sorted(enumerate(ids), key=lambda p: (p[1] is None, -(p[1] or 0), f"t{p[0]}"))
    want = {f"t{n}": f"t{order[(i + 1) % len(order)][0]}" for i, (n, _) in enumerate(order)}
    for bucket_rows in (2, 3, 100):
        assert {r.text: r.next.text for r in om.with_next(df, "k", "text", ["k", "text"], bucket_rows=bucket_rows).collect()} == want


def bucket_rows_of(spark, rows, **options):
    """The rows that each task of the window has."""
    seen = om.with_next(rows, "k", "text", ["k"], **options).withColumn("task", F.spark_partition_id())
    return [r["count"] for r in seen.groupBy("task").count().collect()]


def test_outlier_id_leaves_the_buckets_even(spark):
    ids = spark.range(20_000).union(spark.range(1).select(F.lit(10**15).cast("long"))).select(F.col("id").alias("k"), F.lit("t").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = bucket_rows_of(spark, ids)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(rows) == 20_001 and max(rows) < 10_000


def test_one_id_with_most_rows(spark):
    """An id with many texts is split by their hash; rows that repeat each other are put together."""
    df = spark.range(6_000).select(F.when(F.col("id") < 4_000, 7).otherwise(F.col("id")).alias("k"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = om.with_next(df, "k", "text", ["k", "text"], bucket_rows=100).collect()
    following = {r.text: r.next.text for r in got}
    assert len(following) == len(set(following.values())) == 6_000
    at, seen = "t5999", []
    for _ in range(6_000):
        seen.append(at)
        at = following[at]
    assert at == "t5999" and seen[:2_000] == [f"t{n}" for n in range(5_999, 3_999, -1)] and set(seen[2_000:]) == {f"t{n}" for n in range(4_000)}
    same = [(1, "a b c d e f g")] * 300 + [(None, "")] * 200 + [(2, "h i j k l m")]
    rows = om.edit_likeness(spark.createDataFrame(same, "doc_id long, text string"), bucket_rows=50).collect()
    assert sorted((r.doc_id or 0, r.near_next) for r in rows) == sorted([(1, 1.0)] * 299 + [(1, 0.0)] + [(0, 1.0)] * 199 + [(0, 0.0)] + [(2, 0.0)])


def chained(*values):
    """XXH64 of signed longs one after the other, each seeded by the hash before it."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
    return h - (h >> 63 << 64)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return "0" * (om.HEX * om.SIGNATURES)
    h = [0] * (om.K - 1) + [v - (v >> 63 << 64) for v in (xxhash.xxh64_intdigest(w, 42) for w in words)]
    seen, ring = {}, []
    for place in range(len(words)):
        high = chained(*h[place : place + om.K]) >> 24
        seen[high] = n = seen.get(high, 0) + 1
        again = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), xxhash.xxh64_intdigest(high.to_bytes(8, "little", signed=True), 42))
        ring.append(((again - (again >> 63 << 64)) >> 24, place))
    out = []
    for j in range(om.SIGNATURES):
        # The order of this signature: how far a hash lies past its start on the ring.
        start = (j - om.SIGNATURES // 2) * (1 << 40) // om.SIGNATURES
        least = sorted(ring, key=lambda x: ((x[0] - start) % (1 << 40), x[1]))[: om.PICKS]
        out.append(f"{chained(*[x for x, _ in sorted(least, key=lambda x: x[1])]) & 0xFFFFFFFF:08X}")
    return "".join(out)


def test_fingerprint_against_brute_force(spark):
    texts = ["", "one", "two words", "x y " * 50, prose(1, 30), prose(2, 3_000), "日本語 é́ 😀 don't\r\n x", "again again again"]
    assert prints(spark, texts) == [plain_fingerprint(t) for t in texts]


def test_meaning(spark):
    a = prose(1, 400)
    words = a.split()
    moved = " ".join(words[200:] + words[:200])
    few = " ".join("other" if n % 100 == 50 else w for n, w in enumerate(words))
    same, other, edited, blocks = (like(x, y) for x, y in [(p[0], p[k]) for p in [prints(spark, [a, a, prose(2, 400), few, moved])] for k in (1, 2, 3, 4)])
    assert same == 1.0 and other < 0.1 and edited > 0.6 and edited > other
    # The same k-mers in another order: like by content, less like by order.
    assert blocks < 1.0


def test_order_and_repetition_matter(spark):
    a, b, c, d = prints(spark, ["x y " * 50, "x y " * 51, "y x " * 50, " x  y\n" * 50])
    assert a != b and a != c and a == d


def test_text_without_spaces_is_not_one_k_mer(spark):
    a = prose(5, 300).replace(" ", "")
    p = prints(spark, [a, a[:1000] + "xyz" + a[1000:], prose(6, 300).replace(" ", ""), a[:40], a[:31] + " " + a[32:40]])
    assert like(p[0], p[1]) > 0.6 > 0.2 > like(p[0], p[2]) and p[3] != p[4]


def test_edge_rows(spark, docs, texts):
    rows = om.edit_likeness(docs).collect()
    assert len(rows) == len(texts)
    blank = "0" * (om.HEX * om.SIGNATURES)
    assert {r.fingerprint for r in rows if r.doc_id in (6, 7, 8)} == {blank}
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1 and len({r.fingerprint for r in rows if r.doc_id == 12}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_single_row_and_empty_table(spark, empty):
    one = om.edit_likeness(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert om.edit_likeness(empty).collect() == []


def test_native_plan(spark, mini, capsys):
    om.op9_order_minhash(spark, mini).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
