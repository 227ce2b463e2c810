"""Exact quantiles and samples against numpy and sorting, with small limits so that groups are refined."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import order_stats, reports


def values(seed):
    r = random.Random(seed)
    out = [("normal", r.gauss(0, 1)) for _ in range(700)] + [("ties", float(r.choice([1, 1, 1, 2]))) for _ in range(500)] + [("one", 4.0)] + [("same", 7.0)] * 300
    out += [("wide", r.choice([-1, 1]) * 10.0 ** r.uniform(-200, 200)) for _ in range(400)] + [(None, float(n)) for n in range(333)] + [("few", 1.0), ("few", 3.0)]
    return out + [("normal", None), ("ties", float("nan")), ("normal", float("inf")), ("none", None)]


@pytest.mark.parametrize(("few", "bins"), [(20, 32), (50_000, 1_024)])
def test_quantiles(spark, few, bins):
    rows = values(few)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r.quantiles) for r in order_stats.quantiles(df, ["g"], "v", shares, few, bins).collect()}
    for g in {g for g, _ in rows} - {"none"}:
        own = [v for h, v in rows if h == g and v is not None and np.isfinite(v)]
        assert got[g][0] == len(own) and np.allclose(got[g][1], np.quantile(own, shares), rtol=1e-12, atol=0), g
    assert "none" not in got


def test_without_keys_and_without_rows(spark):
    df = spark.range(1_000).selectExpr("double(id) AS v")
    assert order_stats.quantiles(df, [], "v", [0.25], few=30, bins=16).first().quantiles == [249.75]
    assert order_stats.quantiles(df.filter("v < 0"), [], "v", [0.25]).collect() == []


def test_metrics_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "FEW", 50)
    r = random.Random(3)
    rows = [("a", s, 1.0, 1.0 + (e := r.gauss(0, 2)), -e, abs(e)) for s in "xy" for _ in range(40 if s == "x" else 900)]
    df = spark.createDataFrame(rows, "arm string, signal string, predicted double, actual double, error double, abs_error double")
    for x in reports.metrics(df, ["arm", "signal"]).collect():
        assert abs(x.p90 - np.quantile([v[5] for v in rows if v[1] == x.signal], 0.9)) < 1e-12


def sampled(df):
    return {(r.g, r.id) for r in df.collect()}


def test_a_sample_does_not_depend_on_partitions_and_parts(spark):
    df = spark.range(4_000).select(F.when(F.col("id") < 3_000, "hot").when(F.col("id") < 3_990, "warm").otherwise(F.lit(None)).alias("g"), "id")
    sample = lambda d, seed=1: order_stats.reservoir(d, ["g"], 50, ["id"], seed, few=60, bins=64)
    one = sampled(sample(df))
    assert one == sampled(sample(df.repartition(13).orderBy(F.desc("id")))) and one != sampled(sample(df, 2))
    parts = sample(df.filter("id % 3 = 0")).unionByName(sample(df.filter("id % 3 <> 0"))).drop("_priority")
    assert sampled(sample(parts)) == one
    assert {g: sum(1 for h, _ in one if h == g) for g in ("hot", "warm", None)} == {"hot": 50, "warm": 50, None: 10}
    assert {i for g, i in one if g == "hot"} == set(sorted(range(3_000), key=lambda i: _priority(spark, i))[:50])


_known: dict = {}


def _priority(spark, i):
    if not _known:
        _known.update({r.id: r.p for r in spark.range(4_000).select("id", order_stats.priority([F.col("id")], 1).alias("p")).collect()})
    return _known[i]


def test_samples_are_uniform(spark):
    """Each of 40 rows is in about a quarter of 400 samples of 10."""
    df = spark.range(400).withColumnRenamed("id", "g").crossJoin(spark.range(40))
    rows = order_stats.reservoir(df.select("g", (F.col("g") * 1_000 + F.col("id")).alias("id")), ["g"], 10, ["id"]).collect()
    times = np.bincount([r.id % 1_000 for r in rows], minlength=40)
    assert len(rows) == 4_000 and abs(times - 100).max() < 45 and ((times - 100) ** 2 / 75).sum() < 75


def test_a_batch_is_drawn_from_both(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, "a").otherwise("b").alias("g"), "id", (F.col("id") % 300).cast("double").alias("ts"))
    kept = order_stats.reservoir(df.filter("ts < 200"), ["g"], 80, ["id"], few=50, bins=64)
    batch = order_stats.drawn(df.filter("ts >= 200"), kept, ["g"], 40, 0.25, ["id"], "ts", 9).collect()
    for g in "ab":
        old, new = ([r for r in batch if r.g == g and r.from_reservoir is f] for f in (True, False))
        assert len(old) == 10 and len(new) == 30 and {r.id for r in old} <= {r.id for r in kept.collect()}
        want = sorted(((float(i % 300), i) for i in (range(600) if g == "a" else range(600, 900)) if i % 300 >= 200), reverse=True)[:30]
        assert {r.id for r in new} == {i for _, i in want}
    assert all(not r.from_reservoir for r in order_stats.drawn(df, kept.filter("id < 0"), ["g"], 5, 0.5, ["id"], "ts", 9).collect())
