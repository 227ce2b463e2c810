"""Stored states: resuming is the same as never stopping; what cannot be used is reported. Scans in blocks equal the kernels."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import replay, scan, states
from tidegauge.operators.sequential import AdaptiveWindow, FeatureShift, Hysteresis, PageHinkley, RecursiveLeastSquares, ScopeLearner


def noise(n, seed=1):
    r = random.Random(seed)
    return [abs(r.gauss(5, 1)) + (8 if i > n // 2 else 0) for i in range(n)]


@pytest.mark.parametrize("make", [PageHinkley, AdaptiveWindow])
@pytest.mark.parametrize("cut", [0, 1, 59, 60, 61, 300, 333])
def test_a_detector_goes_on_where_it_stopped(make, cut):
    whole, first = make(), make()
    values = noise(600)
    want = [whole.step(v) for v in values]
    got = [first.step(v) for v in values[:cut]]
    second = states.decode(states.encode(first), make())
    assert got + [second.step(v) for v in values[cut:]] == want


def example(i):
    r = random.Random(i)
    x = [1.0, r.gauss(0, 1), r.gauss(0, 1)]
    import numpy as np

    return {"x": np.array(x), "anchor": 50.0, "vol": 2.0, "actual": 50 + 2 * x[1] + (3 if i > 700 else 0) + r.gauss(0, 0.3), "ts_target": float(i), "regime": r.choice(["a", "b"])}


@pytest.mark.parametrize("cut", [0, 5, 19, 240, 241, 700, 900])
@pytest.mark.parametrize("options", [{}, {"per_regime": True}, {"warmup": 120}, {"correct_only": True, "baselines": (1,)}])
def test_a_learner_goes_on_where_it_stopped(cut, options):
    def run(learner, part):
        return [(learner.predict(example(i)), learner.outcome(example(i), learner.predict(example(i)), float(i)), learner.reason, learner.version, learner.log) for i in part]

    make = lambda: ScopeLearner(3, "s", every=60, gate=40, **options)
    first = make()
    got = run(first, range(cut))
    assert got + run(states.decode(states.encode(first), make()), range(cut, 1000)) == run(make(), range(1000))


def test_no_forecast_before_the_inputs_are_scaled():
    learner = ScopeLearner(3, "s", warmup=120)
    said = []
    for i in range(300):
        said.append(learner.predict(example(i)))
        learner.outcome(example(i), said[-1], float(i))
    # 120 inputs for the scale, then the least number of updates.
    assert all(s is None for s in said[: 120 + learner.least]) and all(s is not None for s in said[120 + learner.least :])


def test_unusable_states_say_why():
    good = states.encode(RecursiveLeastSquares(3))
    whole = json.loads(good)
    for text, why in (
        (None, "unreadable"), ("", "unreadable"), ("[]", "unreadable"), ("{}", "unreadable"), (json.dumps(whole | {"format": 2}), "format 2"), (json.dumps(whole | {"body": whole["body"] + " "}), "digest"),
        (states.encode(RecursiveLeastSquares(4)), "shape"), (states.encode(PageHinkley()), "PageHinkley"), (good.replace("0.0", "1.0", 1), "digest"),
    ):
        with pytest.raises(states.StateError, match=why):
            states.decode(text, RecursiveLeastSquares(3))
    broken = RecursiveLeastSquares(3)
    broken.w[0] = math.nan
    with pytest.raises(states.StateError, match="finite"):
        states.decode(states.encode(broken), RecursiveLeastSquares(3))
    with pytest.raises(states.StateError, match="attributes"):
        states.decode(states.encode(_without(PageHinkley(), "sum")), PageHinkley())
    with pytest.raises(states.StateError, match="cannot hold"):
        states.encode(object())


def _without(kernel, name):
    delattr(kernel, name)
    return kernel


def test_feature_shift_keeps_its_reference():
    import numpy as np

    one, rows = FeatureShift(20, 3.0), [np.array([math.sin(i), i // 50.0]) for i in range(200)]
    for x in rows[:70]:
        one.step(x)
    two = states.decode(states.encode(one), FeatureShift(20, 3.0))
    assert [one.step(x) for x in rows[70:]] == [two.step(x) for x in rows[70:]]


def regression_rows(spark, n=400, signals=3):
    r = random.Random(5)
    return spark.createDataFrame([(f"s{i % signals}", float(i), 1.0, r.gauss(0, 1), None if i % 37 == 0 else r.gauss(0, 2), r.gauss(0, 1)) for i in range(n)], "signal string, ts_target double, one double, a double, b double, y double")


def test_a_replay_resumes_from_a_stored_version(spark, tmp_path):
    rows, x = regression_rows(spark), ("one", "a", "b")
    want = sorted(map(str, replay.online_regression(rows, x, "y").collect()))
    early, kept, problems = replay.resumed_regression(rows.filter("ts_target < 211"), x, "y")
    assert problems.count() == 0 and kept.count() == 3
    states.save(kept, str(tmp_path / "models"), 1)
    with pytest.raises(Exception, match="(?i)exist"):
        states.save(kept, str(tmp_path / "models"), 1)
    late, after, problems = replay.resumed_regression(rows.filter("ts_target >= 211"), x, "y", start=states.load(spark, str(tmp_path / "models")))
    assert sorted(map(str, early.unionByName(late).collect())) == want and problems.count() == 0
    # A key without new rows keeps its state, one without a state begins afresh, a broken one is reported and begins afresh.
    start = after.withColumn("state", F.when(F.col("signal") == "s1", F.replace("state", F.lit("0"), F.lit("7"))).otherwise(F.col("state"))).filter("signal <> 's2'")
    _, again, problems = replay.resumed_regression(rows.filter("ts_target > 390 AND signal <> 's0'"), x, "y", start=start)
    assert [(r.signal, r.problem) for r in problems.collect()] == [("s1", "the digest does not match")]
    assert {r.signal: r.state for r in again.collect()}["s0"] == {r.signal: r.state for r in after.collect()}["s0"]


def test_the_learning_loop_resumes(spark):
    r = random.Random(2)
    rows = []
    for s in ("p", "q"):
        for i in range(400):
            a = r.gauss(0, 1)
            rows.append((s, i * 10.0, i * 10.0 + 35.0, 50.0, 2.0, 50 + 2 * a + r.gauss(0, 0.2), a))
    df = spark.createDataFrame(rows, "signal string, ts double, ts_target double, anchor double, vol double, actual double, x_a double")
    options = {"x": ["x_a"], "baseline_x": ["x_a"], "arms": ("online_periodic_drift", "static"), "every": 40, "gate": 30, "warmup": 20}
    want = sorted(map(str, replay.adaptation(df, **options).collect()))
    for cut in (5.0, 1_234.0, 3_000.0):
        first, kept, _ = replay.resumed_adaptation(df, between=(float("-inf"), cut), **options)
        second, _, problems = replay.resumed_adaptation(df, between=(cut, float("inf")), start=kept, **options)
        assert sorted(map(str, first.unionByName(second).collect())) == want and problems.count() == 0
    assert any("promoted" in w for w in want)


@pytest.mark.parametrize("block_rows", [1, 7, 64, 100_000])
def test_hysteresis_in_blocks(spark, block_rows):
    r = random.Random(block_rows)
    labels = ["idle", "build", "unknown", None, "io", "charging"]
    rows = [(run, k, labels[r.choice([0, 0, 0, 1, 2, 3, 4, 5]) if run == "a" else (k // 9) % 6]) for run in ("a", "b", None) for k in range(150)]
    df = spark.createDataFrame(rows, "run string, k long, raw string")
    got = {(x.run, x.k): x.regime for x in scan.settled(df, block_rows=block_rows).collect()}
    for run in ("a", "b", None):
        one = Hysteresis(3)
        for _, k, raw in sorted((x for x in rows if x[0] == run), key=lambda x: x[1]):
            assert got[run, k] == one.step(raw), (run, k)
    assert len(got) == len(rows)


def test_a_long_run_is_many_tasks(spark):
    df = spark.range(4_000).selectExpr("'all' AS run", "id AS k", "CASE WHEN id % 13 < 6 THEN 'idle' ELSE 'build' END AS raw").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        used = scan.settled(df, block_rows=100).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert used > 1


@pytest.mark.parametrize(("forgetting", "block_rows"), [(1.0, 50), (0.999, 50), (0.97, 17), (0.999, 100_000)])
def test_regression_in_blocks(spark, forgetting, block_rows):
    rows, x = regression_rows(spark, 300, 2), ("one", "a", "b")
    want = {(r.signal, r.ts_target): r.predicted for r in replay.online_regression(rows, x, "y", forgetting=forgetting).collect()}
    got, rounds = scan.online_regression(rows, x, "y", forgetting=forgetting, block_rows=block_rows)
    got = {(r.signal, r.ts_target): r.predicted for r in got.collect()}
    assert rounds == 1 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 or math.isnan(want[k]) for k in want)


def test_a_covariance_scaled_back_is_replayed(spark):
    """An input that stays zero lets the trace grow without bound: the summaries do not know the limit, the replay does."""
    r = random.Random(8)
    rows = [("s", float(i), 1.0, 0.0 if i < 380 else r.gauss(0, 1), r.gauss(0, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "signal string, ts_target double, one double, a double, y double")
    want = {x.ts_target: x.predicted for x in replay.online_regression(df, ("one", "a"), "y", forgetting=0.95).collect()}
    got, rounds = scan.online_regression(df, ("one", "a"), "y", forgetting=0.95, block_rows=60)
    got = {x.ts_target: x.predicted for x in got.collect()}
    assert rounds > 1 and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_hulls_tell_the_greatest_rise_at_any_level():
    r = random.Random(4)
    for n in (1, 2, 3, 17, 100):
        values = [r.gauss(1, 2) for _ in range(n)]
        begins, ends, runs, count, total = scan.runs_hull(values)
        assert count == n and abs(total - sum(values)) < 1e-9
        for c in (-3.0, 0.0, 0.9, 1.0, 1.3, 4.0):
            most = lambda h: max(y - c * x for x, y in h)  # noqa: B023, E731
            moved = [v - c for v in values]
            assert abs(most(begins) - max(sum(moved[: i + 1]) for i in range(n))) < 1e-9
            assert abs(most(ends) - max(sum(moved[i:]) for i in range(n))) < 1e-9
            assert abs(most(runs) - max(sum(moved[i : j + 1]) for i in range(n) for j in range(i, n))) < 1e-9


@pytest.mark.parametrize(("shift", "block_rows", "most"), [(0, 100, 3), (0, 700, 3), (9, 100, 12), (4, 61, 12)])
def test_page_hinkley_in_blocks(spark, shift, block_rows, most):
    """Quiet noise takes a round after the warm-up's; shifts take more, and what is open at last is streamed."""
    r = random.Random(shift)
    values = {s: [abs(r.gauss(5, 1)) + shift * (i // 333 % 2) for i in range(1_500)] for s in ("a", "b")}
    df = spark.createDataFrame([(s, float(i), v) for s, vs in values.items() for i, v in enumerate(vs)], "signal string, ts_target double, abs_error double")
    want = {(x.signal, x.ts_target): (x.statistic, x.alarm, x.event) for x in replay.drift(df, "page_hinkley").collect()}
    found, rounds = scan.drift(df, block_rows=block_rows)
    got = {(x.signal, x.ts_target): (x.statistic, x.alarm, x.event) for x in found.collect()}
    assert found.count() == len(want) and rounds <= most
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1:] == want[k][1:] for k in want)
    assert (shift > 0) == any(w[1] for w in want.values())


def test_what_is_open_after_the_last_round_is_streamed(spark, monkeypatch):
    monkeypatch.setattr(scan, "MOST_ROUNDS", 2)
    r = random.Random(1)
    df = spark.createDataFrame([("s", float(i), abs(r.gauss(5, 1)) + 9 * (i // 150 % 2)) for i in range(1_200)], "signal string, ts_target double, abs_error double")
    want = sorted((x.ts_target, round(x.statistic, 6), x.alarm) for x in replay.drift(df, "page_hinkley").collect())
    found, rounds = scan.drift(df, block_rows=100)
    assert rounds == 2 and sorted((x.ts_target, round(x.statistic, 6), x.alarm) for x in found.collect()) == want


def test_feature_alarms_wait_for_the_cooldown(spark):
    """Against the kernels themselves: windows of ten, shifts all along, so that alarms follow each other within the cooldown."""
    import numpy as np

    from tidegauge.operators.sequential import Cooldown

    r = random.Random(6)
    rows = [("s", 10.0 * i, float(i // 10 * 7) + r.gauss(0, 1), r.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "signal string, ts double, a double, b double")
    got = {x.ts: x for x in replay.feature_drift(df, ["a", "b"], window=10, cooldown=300.0).collect()}
    one, rest, events = FeatureShift(10, 4.0), Cooldown(300.0), []
    for _, ts, a, b in rows:
        alarm, shift, at = one.step(np.array([a, b]))
        event = alarm and rest.step("feature", ts)
        assert (got[ts].alarm, got[ts].event) == (alarm, event) and abs(got[ts].statistic - shift) < 1e-12
        events += [ts] * event
    assert sum(x.alarm for x in got.values()) > len(events) > 1 and all(b - a >= 300 for a, b in zip(events, events[1:]))
