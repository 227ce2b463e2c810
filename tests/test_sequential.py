"""Kernels against plain models, and batch against streaming."""

import math
import random

import numpy as np

from tidegauge.operators import replay
from tidegauge.operators.sequential import AdaptiveInterval, AdaptiveWindow, Buffer, Cooldown, FeatureShift, PageHinkley, RecursiveLeastSquares, ScopeLearner
from tidegauge.sources import datasets, scenarios
from tidegauge.streaming import drivers


def test_recursion_equals_ridge():
    r = np.random.default_rng(0)
    x, y = r.standard_normal((400, 8)), r.standard_normal(400)
    model = RecursiveLeastSquares(8, ridge=2.0)
    for a, b in zip(x, y, strict=True):
        assert model.step(a, b)
    assert np.allclose(model.w, np.linalg.solve(x.T @ x + 2.0 * np.eye(8), x.T @ y), atol=1e-10)
    assert np.allclose(model.p, model.p.T) and not model.step(np.full(8, np.nan), 1.0)


def test_no_false_alarms_and_prompt_detection():
    for seed in range(3):
        r = np.random.default_rng(seed)
        for kind in (PageHinkley, AdaptiveWindow):
            still = kind()
            assert not any(still.step(float(v))[0] for v in r.standard_normal(3000))
            moved = kind()
            assert not any(moved.step(float(v))[0] for v in r.standard_normal(600))
            delay = next(n for n in range(600) if moved.step(float(r.standard_normal() + 4))[0])
            assert delay <= 60


def test_feature_shift_names_the_feature():
    r = np.random.default_rng(1)
    detector = FeatureShift(40)
    rows = r.standard_normal((200, 3))
    rows[100:, 2] += 8
    alarms = [(n, at) for n, row in enumerate(rows) for alarm, _, at in [detector.step(row)] if alarm]
    assert alarms and alarms[0][0] >= 100 and alarms[0][1] == 2


def test_interval_coverage():
    r = np.random.default_rng(3)
    interval, hits = AdaptiveInterval(), []
    for e in np.abs(r.standard_normal(4000)):
        width = interval.width()
        covered = None if width is None else bool(e <= width)
        interval.step(float(e), covered)
        if covered is not None:
            hits.append(covered)
    assert abs(np.mean(hits) - 0.9) < 0.02


def test_cooldown():
    gate = Cooldown(300)
    assert [gate.step("a", t) for t in (0, 100, 300, 599)] == [True, False, True, False] and gate.step("b", 100)


def test_buffer_gate_and_marks():
    buffer = Buffer(recent=10, reservoir=5, seed=1)
    for n in range(30):
        buffer.add({"ts_target": n})
    assert [e["ts_target"] for e in buffer.gate(4)] == [26, 27, 28, 29] and buffer.gate(10) == [] and len(buffer.reservoir) == 5
    batch, mark = buffer.draw(4, 0.0, 26)
    assert [e["ts_target"] for e in batch] == [22, 23, 24, 25] and mark == 26
    buffer.absorbed = mark
    assert buffer.draw(4, 0.0, 26)[0] == []


def test_learner_learns_and_rejects_bad_batches():
    r = random.Random(3)
    learner = ScopeLearner(2, "s", every=40, gate=30)
    decisions, errors = [], []
    for n in range(600):
        x = r.gauss(0, 1)
        e = {"x": np.array([1.0, x]), "anchor": 10.0, "vol": 1.0, "actual": 10.0 + 0.8 * x + r.gauss(0, 0.05), "ts_target": float(n)}
        said = learner.predict(e)
        if said and n > 300:
            errors.append(abs(said[0] - e["actual"]))
        decisions.append(learner.outcome(e, said, float(n)))
    assert {"promoted"} <= set(decisions) and np.mean(errors) < 0.2


def example(x, actual, n, regime=None):
    return {"x": np.array([1.0, x]), "anchor": 10.0, "vol": 1.0, "actual": actual, "ts_target": float(n), "regime": regime}


def driven(learner, rows):
    out = []
    for e in rows:
        out.append((learner.outcome(e, learner.predict(e), e["ts_target"]), learner.reason, learner.trigger))
    return out


def test_gate_reasons():
    r = random.Random(5)
    rows = [example(x := r.gauss(0, 1), 10 + 0.8 * x + r.gauss(0, 0.05), n) for n in range(200)]
    learner = ScopeLearner(2, "s", every=40, gate=60)
    seen = driven(learner, rows)
    assert ("skipped", "insufficient_gate_samples", "periodic_samples") in seen and any(d == "promoted" and why == "within_tolerance" for d, why, _ in seen)
    ungated = ScopeLearner(2, "s", every=40, gate=60, gated=False)
    assert {why for d, why, _ in driven(ungated, rows) if d} == {"gate_disabled"}

    def judged(new, live):
        learner._mae = lambda models, _: new if models == "new" else live
        learner.models = "live"
        return learner._judge("new", [{}])[:2]

    assert judged(1.2, 1.0) == (False, "hard_reject_worse") and judged(1.1, 1.0) == (False, "worse_than_tolerance") and judged(1.0, 1.0) == (True, "within_tolerance") and judged(math.inf, 1.0) == (False, "candidate_non_finite")
    learner.tolerance = 0.1
    assert judged(1.1, 1.0) == (True, "within_tolerance")


def test_policies():
    rows = [example(0.1 * (n % 7), 10.0, n) for n in range(400)]
    due = lambda **o: {t for _, _, t in driven(ScopeLearner(2, "s", every=50, gate=10, **o), rows)} - {None}
    assert due(policies=("periodic_samples",)) == {"periodic_samples"} and due(policies=("drift",)) == set() and due(policies=()) == set()
    assert due(policies=("periodic_time",), seconds=30.0) == {"periodic_time"} and due(policies=("error",), budget=0.0) == {"error"}
    learner = ScopeLearner(2, "s", every=10**6, gate=10)
    driven(learner, rows[:100])
    learner.drifted = True
    assert driven(learner, rows[100:101])[0][2] == "drift" and not learner.drifted


def test_models_by_regime():
    r = random.Random(6)
    rows = []
    for n in range(600):
        x, name = r.gauss(0, 1), "ab"[n // 5 % 2]
        rows.append(example(x, 10 + (2 * x if name == "a" else -2 * x), n, name))
    errors = {}
    for per in (False, True):
        learner = ScopeLearner(2, "s", every=40, gate=40, per_regime=per, forgetting=0.99)
        said = [(learner.predict(e), learner.outcome(e, None, e["ts_target"])) for e in rows]
        errors[per] = np.mean([abs(p[0] - e["actual"]) for (p, _), e in zip(said[400:], rows[400:], strict=True)])
    assert set(learner.models) == {"*", "a", "b"} and errors[True] < 0.5 * errors[False]


def test_correction_spares_the_baselines():
    learner = ScopeLearner(3, "s", baselines=(1,), correct_only=True)
    learner.model.step(np.array([1.0, 1.0, 1.0]), 3.0)
    learner.spreads.extend([1e-9] * 30)
    e = {"x": np.array([1.0, 1.0, 1.0]), "anchor": 0.0, "vol": 1.0}
    spared = learner.model.predict(np.array([1.0, 1.0, 0.0]))
    assert math.isclose(learner._value(learner.models, e), spared, rel_tol=1e-6)
    learner.correct_only = False
    assert abs(learner._value(learner.models, e)) < 1e-6


def test_frozen_learner_stops():
    learner = ScopeLearner(1, "s", every=10, gate=5, frozen_after=100.0)
    for n in range(300):
        e = {"x": np.array([1.0]), "anchor": 0.0, "vol": 1.0, "actual": 1.0, "ts_target": float(n)}
        learner.outcome(e, learner.predict(e), float(n))
        if n == 99:
            version = learner.version
    assert learner.version == version


def _errors(spark):
    r = np.random.default_rng(9)
    rows = [(s, float(300 * n), float(abs(r.standard_normal()) + (5 if n > 150 and s == "b" else 0))) for s in "ab" for n in range(260)]
    return spark.createDataFrame(rows, "signal string, ts_target double, abs_error double")


def test_streaming_equals_batch(spark, tmp_path):
    errors = _errors(spark)
    source = str(tmp_path / "in")
    errors.repartition(1).sortWithinPartitions("ts_target").write.parquet(source)
    stream = drivers.drift(spark.readStream.schema(errors.schema).parquet(source))
    got = drivers.run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    key = lambda df: sorted((r.signal, r.ts_target, round(r.statistic, 9), r.alarm, r.event) for r in df.collect())
    batch = key(replay.drift(errors, "page_hinkley"))
    assert key(got) == batch and any(x[4] for x in batch)


def test_batch_does_not_depend_on_partitions(spark):
    errors = _errors(spark)
    one, many = (sorted(map(tuple, replay.drift(errors.repartition(n), "adwin").collect())) for n in (1, 7))
    assert one == many


def test_live_windows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 10.0 * n, float(n)) for n in range(720)], "signal string, ts double, value double").selectExpr("timestamp_seconds(ts) AS at", "signal", "value")
    source = str(tmp_path / "in")
    rows.repartition(1).write.parquet(source)
    got = drivers.run_once(drivers.live_windows(spark.readStream.schema(rows.schema).parquet(source)), str(tmp_path / "out"), str(tmp_path / "check")).collect()
    assert got and all(r.n == 360 for r in got)


def test_dataset_round_trip(spark, tmp_path):
    signals = spark.createDataFrame([("cpu", "percent", "gauge", 0.0, 100.0, None, 30.0, "x")], "name string, unit string, kind string, lo double, hi double, max_rate_per_s double, max_hold_s double, description string")
    rows = [(float(n), "live", None if n == 0 else 5.0, 1.0, {"cpu": (float(n), 0) if n != 2 else (None, 5), "mem": (1.0, 3)}) for n in range(4)]
    samples = spark.createDataFrame(rows, "ts double, origin string, gap_s double, collect_ms double, readings map<string,struct<value:double,quality:int>>")
    datasets.write(samples, signals, str(tmp_path / "d"), "note")
    got, specs = datasets.read(spark, str(tmp_path / "d"))
    assert sorted((r.ts, r.signal, r.value is None, r.quality) for r in got.collect()) == sorted((t, s, v is None, q) for t, _, _, _, m in rows for s, (v, q) in m.items())
    assert specs.first().name == "cpu" and specs.first().max_hold_s == 30.0


def test_scenarios_repeat_and_stay_in_range():
    for name in scenarios.SCENARIOS:
        a, b = scenarios.rows(name, 12), scenarios.rows(name, 12)
        assert a == b and a
        assert all(0 <= r[5] <= 120 and math.isfinite(r[5]) for r in a)
    assert {r[1] for r in scenarios.rows("idle_to_build")} == {"idle", "build", "idle_after"}
    ticks = {r[2] for r in scenarios.rows("gappy_idle")}
    assert len(ticks) < 540


def test_keyed_hysteresis(spark):
    raw = ["unknown", "a", "b", "b", "b", "unknown", "c", "c", "c"]
    df = spark.createDataFrame([("r", n, x) for n, x in enumerate(raw)], "run string, k long, raw string")
    assert [r.regime for r in replay.settled(df).orderBy("k").collect()] == ["unknown", "unknown", "unknown", "unknown", "b", "b", "b", "b", "c"]
