"""Hand-computed cases of the telemetry operators."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.operators import baselines, features, learning, quality, regime, replay, reports, store

T0 = 1_760_000_000.0
SPECS = [("cpu", 0.0, 100.0, None, 30.0), ("battery", 0.0, 100.0, 0.5, 120.0)]


def specs(spark):
    return spark.createDataFrame(SPECS, "signal string, lo double, hi double, max_rate double, max_hold double")


def normal(spark, rows):
    """rows: (tick, seconds after T0, signal, raw)."""
    df = spark.createDataFrame([(k, T0 + s, sig, v) for k, s, sig, v in rows], "k long, ts double, signal string, value double")
    return {(r.k, r.signal): r for r in quality.normalise(df, specs(spark), 5.0).collect()}


def test_hold_then_missing(spark):
    got = normal(spark, [(0, 0, "cpu", 40.0), (1, 5, "cpu", None), (2, 15, "cpu", None), (3, 30, "cpu", None), (4, 45, "cpu", None)])
    assert [(got[k, "cpu"].value, got[k, "cpu"].quality) for k in range(5)] == [(40.0, 0), (40.0, 3), (40.0, 3), (40.0, 3), (None, 5)]


def test_gap_clears_hold(spark):
    got = normal(spark, [(0, 5, "cpu", 40.0), (1, 4000, "cpu", None)])
    assert got[1, "cpu"].gap_s == 3995 and got[1, "cpu"].quality == quality.MISSING and got[1, "cpu"].value is None


def test_clamp_and_slack(spark):
    got = normal(spark, [(0, 0, "cpu", 150.0), (1, 5, "cpu", -3.0), (2, 10, "cpu", 100.0000001)])
    assert [(got[k, "cpu"].value, got[k, "cpu"].quality) for k in range(3)] == [(100.0, 1), (0.0, 1), (100.0, 0)]


def test_spike_is_suspect_and_kept(spark):
    got = normal(spark, [(0, 0, "battery", 80.0), (1, 5, "battery", 20.0)])
    assert (got[1, "battery"].value, got[1, "battery"].quality) == (20.0, quality.SUSPECT)


def test_malformed_values_are_missing(spark):
    got = normal(spark, [(0, 0, "cpu", float("nan")), (1, 5, "cpu", float("inf")), (2, 10, "cpu", float("-inf"))])
    assert all(got[k, "cpu"].value is None for k in range(3))


def test_rows_are_completed_and_unknown_signals_dropped(spark):
    got = normal(spark, [(0, 0, "cpu", 1.0), (0, 0, "other", 1.0)])
    assert set(got) == {(0, "cpu"), (0, "battery")} and got[0, "battery"].quality == quality.MISSING


def test_counter_rate(spark):
    df = spark.createDataFrame([(n, "c", T0 + t, float(v)) for n, (t, v) in enumerate([(0, 1000), (10, 2000), (20, 500), (30, 1500), (30, 1600)])], "seq long, signal string, ts double, value double")
    assert [r.rate for r in quality.counter_rate(df).orderBy("seq").collect()] == [None, 100.0, None, 100.0, None]


def scored(spark, rows):
    df = spark.createDataFrame([(a, "s", 300.0, float(n), float(n), float(p), float(y)) for a, n, p, y in rows], "arm string, signal string, horizon double, ts double, ts_target double, predicted double, actual double")
    return df.withColumns({"error": F.col("predicted") - F.col("actual"), "abs_error": F.abs(F.col("predicted") - F.col("actual"))})


def test_metrics(spark):
    r = reports.metrics(scored(spark, [("a", 0, 12, 10), ("a", 1, 18, 20), ("a", 2, 33, 30)]), ["arm"]).first()
    assert r.n == 3 and math.isclose(r.mae, 7 / 3) and math.isclose(r.rmse, math.sqrt(17 / 3)) and math.isclose(r.bias, 1) and r.max_abs == 3


def test_metrics_leave_out_non_finite(spark):
    assert reports.metrics(scored(spark, [("a", 0, 1, 1), ("a", 1, 2, float("nan")), ("a", 2, 3, 3)]), ["arm"]).first()[1:3] == (2, 0.0)


def test_skill(spark):
    report = spark.createDataFrame([("persistence", "s", 2.0), ("x", "s", 1.0)], "arm string, signal string, mae double")
    assert {r.arm: r.skill for r in reports.with_skill(report, ["signal"]).collect()} == {"persistence": 0.0, "x": 0.5}


def test_embargo(spark):
    df = spark.createDataFrame([("s", k, float(5 * k)) for k in range(1000)], "signal string, k long, ts double")
    parts = {r.part: (r.a, r.b) for r in reports.chronological_split(df, 900).groupBy("part").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    assert parts["validation"][0] - parts["train"][1] >= 900 and parts["test"][0] - parts["validation"][1] >= 900


def test_linear_trend(spark):
    df = spark.createDataFrame([("s", k, 5.0 * k, 10 + 0.1 * k) for k in range(80)], "signal string, k long, ts double, value double")
    last = baselines.forecasts(df, 300, 300, 120, 0, 100).filter("k = 79").first()
    assert math.isclose(last.linear_trend, 23.9, rel_tol=0.05) and last.persistence == last.anchor == 10 + 0.1 * 79


def test_resolution_against_a_sequential_model(spark):
    r = np.random.default_rng(8)
    ticks, t = [], 0.0
    for _ in range(600):
        t += float(r.choice([1, 3, 5, 5, 5, 9, 40]))
        ticks.append((t, None if r.random() < 0.3 else float(r.integers(100))))
    targets = [float(x) for x in r.uniform(0, t + 10, 300).round(1)]
    tolerance = 7.5

    def plain(target):
        for n, (now, _) in enumerate(ticks):
            if now >= target:
                near = [(abs(s - target), -s, v) for s, v in ticks[: n + 1] if v is not None and s >= target - tolerance and abs(s - target) <= tolerance]
                if near:
                    return min(near)[2]
                if now - target > tolerance:
                    return None
        return None

    left = spark.createDataFrame([("s", n, x) for n, x in enumerate(targets)], "signal string, id long, ts_target double")
    right = spark.createDataFrame([("s", a, b) for a, b in ticks], "signal string, ts double, value double")
    assert {x.id: x.actual for x in baselines.resolve(left, right, 5.0).collect()} == {n: plain(x) for n, x in enumerate(targets)}


def test_hysteresis_against_a_state_machine(spark):
    r = np.random.default_rng(5)
    raw = [str(x) for x in r.choice(list("abc"), 500, p=[0.6, 0.2, 0.2])]
    label, candidate, streak, want = raw[0], raw[0], 0, []
    for x in raw:
        if x == label:
            candidate, streak = x, 0
        else:
            streak = streak + 1 if x == candidate else 1
            candidate = x
            if streak >= 3:
                label, streak = x, 0
        want.append(label)
    df = spark.createDataFrame(list(enumerate(raw)), "k long, raw string")
    assert [x.regime for x in replay.settled(df.withColumn("run", F.lit("r"))).orderBy("k").collect()] == want


def test_lag_falls_back(spark):
    df = spark.createDataFrame([("s", k, 5.0 * k, v) for k, v in enumerate([1.0, 2.0, None, 4.0, None])], "signal string, k long, ts double, value double")
    r = features.with_lags(df, [0.0, 10.0, 500.0], 5.0).filter("k = 4").first()
    assert (r.lag_0, r.lag_10) == (4.0, 2.0) and math.isclose(r.lag_500, 7 / 3)


def test_prune_protects_active_and_parent(spark):
    versions = spark.createDataFrame([("m", "s", n, float(n), n - 1 if n > 1 else None) for n in range(1, 8)], "kind string, scope string, version_n long, created_ts double, parent_n long")
    activations = spark.createDataFrame([("m", "s", n, n) for n in range(1, 8)], "kind string, scope string, version_n long, seq long")
    assert sorted(r.version_n for r in store.pruned(versions, activations, 1).collect()) == [1, 2, 3, 4, 5]
    assert store.rollback_target(versions, activations).first().target_n == 6 and store.next_version(versions).first().next_n == 8


def test_pivot_has_nulls(spark):
    df = spark.createDataFrame([(0, "a", 1.0, 0), (0, "b", 2.0, 5), (1, "a", 3.0, 0)], "k long, signal string, value double, quality int")
    assert [tuple(r) for r in store.pivot_window(df, ["a", "b", "c"], quality="quality").orderBy("k").collect()] == [(0, 1.0, None, None), (1, 3.0, None, None)]


def test_gram_solves_ridge(spark):
    r = np.random.default_rng(4)
    x, w = r.standard_normal((200, 2)), np.array([2.0, -1.0])
    df = spark.createDataFrame([("s", float(a), float(b), float(a * 2 - b)) for a, b in x], "signal string, a double, b double, y double")
    g = {(c.i, c.j): c.value for c in learning.gram(df, ["a", "b"], "y").collect()}
    solved = np.linalg.solve([[g[0, 0], g[0, 1]], [g[0, 1], g[1, 1]]], [g[0, 2], g[1, 2]])
    assert np.allclose(solved, w)


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_windows_in_blocks_are_windows_over_all(spark, size):
    r = np.random.default_rng(7)
    order = sorted(set(r.integers(0, 400, 120).tolist()))
    rows = [(key, float(k) * 10, k, None if r.random() < 0.3 else float(r.integers(0, 50)), str(r.choice(list("ab")))) for key in ("x", None) for k in order]
    df = spark.createDataFrame(rows, "key string, ts double, k long, value double, regime string")
    w = Window.partitionBy("key").orderBy("k")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))

    gap = F.col("ts") - F.lag("ts").over(w)
    plain = df.withColumn("gap_s", gap).withColumn("discontinuity", F.coalesce(F.col("gap_s") > 60.0, F.lit(False)))
    plain = plain.withColumn("segment", F.sum(F.col("discontinuity").cast("long")).over(w))
    assert same(quality.gaps(df, 20.0, ["key"], span=size), plain)

    plain = df.withColumn("share_a", F.sum((F.col("regime") == "a").cast("double")).over(w.rowsBetween(-9, 0)) / F.count("*").over(w.rowsBetween(-9, 0)))
    assert same(regime.shares(df, ["a"], ["key"], history=10, span=size, block=size), plain)

    known = F.when(F.col("value").isNotNull(), F.struct("ts", "value"))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    plain = df.withColumn("_b", before).withColumn("rate", F.when(F.col("value") >= F.col("_b")["value"], (F.col("value") - F.col("_b")["value"]) / (F.col("ts") - F.col("_b")["ts"])))
    assert same(quality.counter_rate(df, ["key"], "k", span=size), plain.drop("_b"))

    plain = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_t", F.count("*").over(Window.partitionBy("key"))).filter("_i % ceil(_t / 20) = 0")
    assert same(store.decimated(df, 20, ["key"], ["k"], span=size), plain.drop("_i", "_t"))

    from tidegauge.operators import evidence

    assert same(evidence.regime_spells(df, by=["key"], span=size), evidence.regime_spells(df, by=["key"], span=10_000))
