"""Operator 4: resampling decisions, the weights against a plain computation, edge rows."""

import numpy as np

from tidegauge.llm import quality


def test_keeps_good_and_rejects_bad(spark, docs, labels, texts):
    rows = quality.resample(docs, labels).collect()
    assert len(rows) == len(texts)
    kept = {}
    for r in rows:
        kept.setdefault(r.row.doc_id, r.kept)
    assert all(kept[i] for i in (1, 2, 3, 4, 5, 40))
    few = {r.row.doc_id: r.kept for r in quality.resample(docs, labels, k=len(texts) - 4).collect()}
    assert not few[13] and not few[14] and few[1]
    assert {r.log_weight for r in rows if r.row.doc_id in (6, 7, 8)} == {0.0}


def test_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = quality.resample(docs, half).selectExpr("row.doc_id AS doc_id", "kept").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.kept for r in judged if r.quality == 1]
    bad = [r.kept for r in judged if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_weights_are_the_models_log_ratio(spark, docs, labels, texts):
    sample = quality.sampled_labels(labels)
    ratio = quality.fit(docs, sample)
    of = quality.BucketCounts()
    good = {1, 2, 3, 4, 5, 40}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in texts:
        counts = np.bincount(of(t or "").astype(int), minlength=quality.BUCKETS)
        raw += counts
        target += counts * (i in good)
    share = (raw + 1) / (raw + 1).sum()
    want = np.log((target + quality.BUCKETS * share) / (target.sum() + quality.BUCKETS) / share)
    assert np.allclose(ratio, want)


def test_conflicting_labels_are_bad(spark):
    rows = {r.doc_id: r.good for r in quality.sampled_labels(spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")).collect()}
    assert rows == {1: False, 2: True}


def test_size_of_the_sample():
    assert quality.size_of_sample(100, 0, 0) == quality.size_of_sample(100, 5, 5) == quality.size_of_sample(100, 5, 0) == 100
    assert quality.size_of_sample(10_000, 400, 320, 0.0) == 8_000 and quality.size_of_sample(10_000, 400, 320) == 8_200
    assert quality.size_of_sample(0, 4, 2) == 0


def test_default_k_by_brute_force(spark, sf_dir):
    """``kept`` as the query makes it: log weights and Gumbel variates computed here, the k greatest of a plain sort."""
    import math

    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    seen = {}
    for r in labels.collect():
        seen[r.doc_id] = min(seen.get(r.doc_id, 1), r.quality)
    of = quality.BucketCounts()
    counts = {i: np.bincount(of(t).astype(int), minlength=quality.BUCKETS) for i, t in rows}
    raw, target = sum(counts.values()).astype(float), sum(c for i, c in counts.items() if seen.get(i) == 1).astype(float)
    share = (raw + 1) / (raw + 1).sum()
    ratio = np.log((target + quality.BUCKETS * share) / (target.sum() + quality.BUCKETS) / share)
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(docs.doc_id).alias("g")).collect()}
    score = {i: float((counts[i] * ratio).sum()) + noise[i] for i, _ in rows}
    good, n = sum(seen.values()), len(seen)
    k = math.ceil(len(rows) * (good / n + math.sqrt(good / n * (1 - good / n) / n)))
    got = quality.op4_importance_resampling(spark, sf_dir).collect()
    assert {r.k for r in got} == {k} and k < len(rows)
    assert {r.doc_id for r in got if r.kept} == set(sorted(score, key=score.get, reverse=True)[:k])


def test_without_labels_all_stay(spark, docs, labels, texts):
    none = labels.filter("doc_id < 0")
    out = quality.keep(docs, none)
    assert out.count() == len(texts) and out.columns == docs.columns


def test_k_greatest(spark, docs, labels):
    """An explicit k against a plain sort, in few and in many rounds."""
    for k in (1, 7):
        rows = quality.resample(docs, labels, k=k).collect()
        level = sorted((r.score for r in rows), reverse=True)[k - 1]
        assert all(r.kept == (r.score >= level) and r.k == k for r in rows)
    values = [float(v) for v in np.random.default_rng(3).standard_t(2, 500)] + [2.5] * 40
    df = spark.createDataFrame([(v,) for v in values], "score double")
    for k in (1, 2, 37, 250, 540, 900):
        assert quality.kth_greatest(df, k, bins=8, few=3) == sorted(values, reverse=True)[min(k, 540) - 1]
    assert quality.kth_greatest(df, 0) == np.inf


def test_keep_carries_all_columns(spark, docs, labels):
    out = quality.keep(docs, labels)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.filter("doc_id = 1").first().score == 1.0


def test_gumbel_is_standard(spark):
    g = [r[0] for r in spark.range(20_000).select(quality.gumbel(__import__("pyspark.sql.functions", fromlist=["col"]).col("id"))).collect()]
    assert abs(np.mean(g) - 0.5772) < 0.03 and abs(np.std(g) - np.pi / 6**0.5) < 0.03


def test_empty_table(empty, labels):
    assert quality.keep(empty, labels).collect() == []
