"""Evidence at many times against the operators of one time and plain models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import answers, evidence
from tidegauge.operators import evidence_at as at
from tidegauge.plans import packs

ASK = "ask long, now double, focus string, intent string, question string"
ROW = "signal string, ts double, value double"


def asks_of(spark, rows):
    return spark.createDataFrame([(i, now, focus, "status", "") for i, (now, focus) in enumerate(rows)], ASK)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(7)
    data = [("a", 10.0 * i, None if i % 17 == 0 else 1e6 + rng.gauss(0, 5) - 0.01 * i) for i in range(400)] + [("b", 10.0 * i, float(i % 7)) for i in range(0, 400, 3)]
    return data, spark.createDataFrame(data, ROW)


@pytest.mark.parametrize("cells", [1, 3, 16, 1000])
def test_summaries_are_those_of_whole_windows(spark, noisy, cells):
    data, rows = noisy
    times = [-5.0, 0.0, 95.0, 1000.0, 1003.7, 2718.28, 3990.0, 9999.0]
    got = {(r.ask, r.signal): r for r in at.summarised(asks_of(spark, [(t, None) for t in times]), rows, 600.0, ["signal"], cells=cells).collect()}
    for i, now in enumerate(times):
        for signal in ("a", "b"):
            inside = [(t, v) for s, t, v in data if s == signal and now - 600 <= t <= now]
            usable = [(t, v) for t, v in inside if v is not None]
            if not inside:
                assert (i, signal) not in got
                continue
            r = got[i, signal]
            assert r.n == len(usable) and tuple(r.latest) == max(inside, key=lambda p: p[0])
            if usable:
                ts, vs = map(np.array, zip(*usable, strict=True))
                assert (r.low, r.high, r.first_ts, r.last_ts, r.change) == (vs.min(), vs.max(), ts[0], ts[-1], vs[-1] - vs[0])
                assert math.isclose(r.mean, vs.mean(), rel_tol=1e-12)
                want = np.polyfit(ts - ts.mean(), vs - vs.mean(), 1)[0] if len(ts) > 1 else 0.0
                assert math.isclose(r.slope, want, rel_tol=1e-4, abs_tol=1e-7)


def test_windows_equal_the_operator_of_one_time(spark, noisy):
    data, rows = noisy
    times = [700.0, 1234.0, 3000.0]
    got = at.windows(asks_of(spark, [(t, None) for t in times]), rows, 500.0, ("a", "b")).collect()
    for i, now in enumerate(times):
        want = {r.signal: r for r in evidence.window_facts(rows.filter(F.col("ts") <= now), now, 500.0).collect()}
        mine = {r.signal: r for r in got if r.ask == i}
        assert set(mine) == set(want) and [r.signal for r in sorted(mine.values(), key=lambda r: r.place)] == ["a", "b"]
        for s, r in mine.items():
            assert (r.n, r.low, r.high, r.change) == (want[s].n, want[s].low, want[s].high, want[s].change) and math.isclose(r.mean, want[s].mean, rel_tol=1e-12)


def test_focus_goes_first_and_brings_few_others(spark, noisy):
    _, rows = noisy
    more = rows.unionByName(rows.filter("signal = 'b'").withColumn("signal", F.lit("c"))).unionByName(rows.filter("signal = 'b'").withColumn("signal", F.lit("d")))
    got = at.windows(asks_of(spark, [(2000.0, "d"), (2000.0, "a"), (2000.0, None), (2000.0, "none")]), more, 500.0, ("a", "b", "c"), more=1, alone=("a",)).collect()
    named = lambda i: [r.signal for r in sorted(got, key=lambda r: r.place) if r.ask == i]
    assert [named(i) for i in range(4)] == [["d", "a"], ["a"], ["a", "b", "c"], ["a"]]


def test_nothing_later_counts(spark, noisy):
    _, rows = noisy
    asked = asks_of(spark, [(1500.0, "a"), (2222.0, "b")])
    later = rows.unionByName(spark.createDataFrame([("a", 2222.5, -1e9), ("b", 2222.5, -1e9)], ROW))
    for make in (lambda r: at.windows(asked, r, 600.0, ("a", "b")), lambda r: at.current(asked, r, ("a", "b")), lambda r: at.levels(asked, r, 600.0, "a", "p", "b"),
                 lambda r: at.drivers(asked, r.filter("ts % 30 = 0 OR ts = 2222.5"), ("a", "b"), 900.0, 30.0)):
        assert sorted(map(str, make(rows).collect())) == sorted(map(str, make(later).filter("ask < 2").collect()))


@pytest.mark.parametrize("span", [1.0, 37.0, 1e6])
def test_newest_before_and_at_a_time(spark, span):
    rows = spark.createDataFrame([(5.0, "x"), (5.0, "y"), (9.0, "z"), (None, "never")], "ts double, what string")
    asked = spark.createDataFrame([(0, 4.0), (1, 5.0), (2, 8.0), (3, 9.0), (4, 900.0), (5, None)], "ask long, now double")
    of = lambda **kw: {r.ask: r.what for r in at.newest(asked, rows, "ts", {"what": F.col("what")}, span=span, **kw).collect()}
    assert of() == {0: None, 1: "y", 2: "y", 3: "z", 4: "z"}
    assert of(strictly=True) == {0: None, 1: None, 2: "y", 3: "y", 4: "z"}


@pytest.mark.parametrize("span", [2.0, 50.0, 1e6])
@pytest.mark.parametrize("limit", [5, 4000])
def test_regimes_against_a_plain_walk(spark, span, limit):
    rng = random.Random(3)
    rows, now_regime = [], "p"
    for i in range(120):
        now_regime = rng.choice("pqr") if rng.random() < 0.3 else now_regime
        rows.append((i, float(10 * i), float(10 * i + 30), now_regime))
    asked = [(j, float(j * 37 % 1500) - 50) for j in range(40)]
    got = {r.ask: r for r in at.regimes(spark.createDataFrame(asked, "ask long, now double"), spark.createDataFrame(rows, "id long, ts double, ts_target double, regime string"), "pqr", 200.0, limit, span).collect()}
    for ask, now in asked:
        made = [r for r in rows if r[1] <= now]
        seen = [r for r in rows if now - 200 <= r[2] <= now][:limit]
        regime = made[-1][3] if made and made[-1][2] > now else seen[-1][3] if seen else "unknown"
        assert got[ask].regime == regime
        if not seen:
            assert got[ask].shares is None and got[ask].since_s == 0
            continue
        began = seen[-1][1]
        for r in reversed(seen):
            if r[3] != regime:
                break
            began = r[1]
        assert got[ask].since_s == max(0.0, now - began)
        assert [round(s, 9) for s in got[ask].shares] == [round(sum(r[3] == x for r in seen) / len(seen), 9) for x in "pqr"]


def test_levels_need_a_fall_and_no_plug(spark):
    fall = [("l", 60.0 * i, 50.0 - i) for i in range(20)]
    asked = asks_of(spark, [(1140.0, None), (120.0, None)])
    row = lambda extra: {r.ask: r for r in at.levels(asked, spark.createDataFrame(fall + extra, ROW), 60.0, "l", "p", "w").collect()}
    # The window is at least half an hour, three values are too few.
    free = row([("w", 0.0, 8.0), ("w", 60.0, None)])
    assert set(free) == {0} and not free[0].plugged and free[0].power == 8.0
    assert math.isclose(free[0].per_minute, -1.0) and math.isclose(free[0].minutes_to_20, 11.0) and math.isclose(free[0].minutes_to_0, 31.0)
    plugged = row([("p", 1140.0, 1.0)])[0]
    assert plugged.plugged and plugged.minutes_to_20 is None and plugged.power is None
    # A plug that was not read at the last tick, or was read as nothing, is none.
    assert not row([("p", 1080.0, 1.0)])[0].plugged and not row([("p", 1140.0, None)])[0].plugged


def test_drivers_find_the_lag(spark):
    rng = random.Random(5)
    lead = [rng.gauss(0, 1) for _ in range(80)]
    data = [("d", 20.0 * i, lead[i]) for i in range(80)] + [("y", 20.0 * i, 3 * lead[i - 2] if i >= 2 else 0.0) for i in range(80)] + [("flat", 20.0 * i, 4.0) for i in range(80)]
    asked = asks_of(spark, [(1580.0, "y"), (1580.0, None), (100.0, "y")])
    got = at.drivers(asked, spark.createDataFrame(data, ROW), ("d", "y", "flat", "absent"), 1600.0, 20.0).collect()
    assert [(r.ask, r.driver, r.lag_s, r.place) for r in got] == [(0, "d", 40.0, 1)] and got[0].r > 0.999 and math.isclose(got[0].change, lead[79] - lead[0])


def test_skipped_adaptations_are_counted_and_dropped(spark):
    drift = spark.createDataFrame([(i, 100.0, "s") for i in range(30)], "id long, ts double, what string")
    moves = spark.createDataFrame([(i, 100.0 + (i > 5), "promoted" if i < 12 else "skipped") for i in range(30)], "id long, ts double, what string")
    got = sorted(at.events(asks_of(spark, [(200.0, None), (99.0, None)]), drift, moves, 500.0).collect(), key=lambda r: r.place)
    assert [(r.kind, r.id) for r in got] == [("adaptation", 11), ("adaptation", 10)] + [("drift", i) for i in range(29, 19, -1)]


def test_empty_tables_and_repeated_rows(spark, noisy):
    data, rows = noisy
    none, asked = rows.limit(0), asks_of(spark, [(2000.0, "a")])
    parts = lambda r, q: (at.windows(q, r, 600.0, ("a", "b")), at.current(q, r, ("a",)), at.levels(q, r, 600.0, "a", "p", "b"), at.drivers(q, r, ("a", "b"), 600.0, 10.0))
    assert all(p.count() == 0 for p in parts(none, asked)) and all(p.count() == 0 for p in parts(rows, asked.limit(0)))
    assert at.stamps(spark, none, 5).count() == 0 and at.stamps(spark, rows.limit(1), 5).count() == 0
    twice = at.windows(asked, rows.unionByName(rows), 600.0, ("a",)).collect()[0]
    once = at.windows(asked, rows, 600.0, ("a",)).collect()[0]
    assert (twice.n, twice.low, twice.change) == (2 * once.n, once.low, once.change)
    pack = at.packs(asked, {"current": at.current(asked, none, ("a",)), "window": at.windows(asked, rows, 600.0, ("a",))}).collect()[0]
    assert (pack.current, pack.window, pack.notes) == ([], [], ["no_telemetry"])


def test_language_dataset(spark, sf_dir):
    rows = packs.language_dataset(spark, sf_dir).collect()
    times = sorted(r.now for r in rows)
    assert len(rows) > 100 and min(b - a for a, b in zip(times, times[1:], strict=False)) >= packs.GAP - 1e-3
    train, test = ([r.now for r in rows if r.split == s] for s in ("train", "test"))
    assert max(train) < min(test) and len(train) == int(len(rows) * 0.7)
    assert len({r.question for r in rows}) == len(packs.QUESTIONS) and {"battery", "why_change", "forecast", "anomaly", "adaptation"} <= {r.intent for r in rows}
    # All numbers that are not lengths of time stand for facts.
    said = spark.createDataFrame([(r.now, r.target, r.surface) for r in rows], "now double, target string, surface array<double>")
    bare = F.regexp_replace("target", r"[0-9.]+ (s|min|h|days)\b|about \d+ minutes|until \d+%", "")
    loose = said.select("target", answers.numbers(bare).alias("n"), "surface").filter(answers.grounded(F.col("n"), F.col("surface")) < F.size("n"))
    assert loose.limit(3).collect() == []
