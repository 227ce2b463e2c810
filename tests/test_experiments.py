"""Suites of arms: the split, the refusals, and reports against plain SQL and sums."""

import glob
import math
import os

import duckdb
import pytest

from tidegauge.operators import experiments, replay
from tidegauge.plans import sequential
from tidegauge.plans.telemetry import BASE


@pytest.fixture(scope="module")
def report(spark, sf_dir):
    return sequential.experiment_suites(spark, sf_dir).collect()


def test_boundary_is_the_sample_at_the_share(spark):
    times = spark.createDataFrame([(float(i * i),) for i in range(300)] * 2 + [(None,)], "ts double")
    assert experiments.boundary(times, 0.5) == 150.0 ** 2 and experiments.boundary(times, 0.7) == 210.0 ** 2 and experiments.boundary(times, 1.0) == 299.0 ** 2
    with pytest.raises(ValueError, match="199 samples"):
        experiments.boundary(times.filter("ts < 199 * 199"))
    with pytest.raises(ValueError, match="0 samples"):
        experiments.boundary(times.limit(0))


def test_arms_on_different_data_are_refused(spark):
    rows = [(a, s, float(e)) for a in ("p", "q") for s in ("x", "y") for e in range(5)]
    of = lambda data: spark.createDataFrame(data, "arm string, signal string, abs_error double")
    experiments.check_same_data(of(rows))
    experiments.check_same_data(of([]))
    for other in (rows[:-1], rows[:-5], [*rows[:-1], ("q", "y", 4.5)], [*rows, ("q", "z", 1.0)]):
        with pytest.raises(AssertionError, match="different data"):
            experiments.check_same_data(of(other))


def test_unknown_arms_and_few_samples_are_refused_before_a_replay(spark):
    some = spark.createDataFrame([], "signal string, ts double, ts_target double, anchor double, vol double, actual double")
    with pytest.raises(ValueError, match="unknown arms"):
        experiments.run(some, some, [], suites={"s": ("nobody",)})
    with pytest.raises(ValueError, match="too few"):
        experiments.run(some, some, [], suites={"s": ("static",)})


def test_suites_share_one_replay(report):
    by = {}
    for r in report:
        by.setdefault(r.suite, {}).setdefault(r.arm, {})[r.part, r.slice, r.signal] = r
    assert set(by) == set(experiments.SUITES) and set(by["full"]) == {*replay.ARMS, "persistence"}
    for suite, arms in experiments.SUITES.items():
        assert set(by[suite]) == {*arms, "persistence"}
        for arm in by[suite]:
            assert [tuple(r)[1:] for r in by[suite][arm].values()] == [tuple(by["full"][arm][k])[1:] for k in by[suite][arm]]


def test_slices_add_up_and_skill_is_against_persistence(report):
    rows = {(r.arm, r.part, r.slice, r.signal): r for r in report if r.suite == "full"}
    for (arm, part, slice_, signal), r in rows.items():
        ref = rows["persistence", part, slice_, signal]
        assert (r.skill is None and ref.mae == 0) or math.isclose(r.skill, 1 - r.mae / ref.mae, abs_tol=1e-12)
        if part == "all":
            for other in ("regime", "window"):
                pieces = [q for k, q in rows.items() if k[0] == arm and k[1] == other and k[3] == signal]
                assert sum(q.n for q in pieces) == r.n and math.isclose(sum(q.n * q.mae for q in pieces), r.n * r.mae, rel_tol=1e-9)
    assert {k[2] for k in rows if k[1] == "window"} == {"0", "1", "2", "3"}


def test_persistence_against_sql(report, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(f"""WITH {BASE}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM grid))
        SELECT signal, count(*), avg(abs_error), avg(error) FROM scored WHERE arm = 'persistence' AND ts_target >= (SELECT ts FROM t WHERE i = floor(n * 0.5)) GROUP BY signal""").fetchall()
    got = {r.signal: r for r in report if (r.suite, r.arm, r.part) == ("core", "persistence", "all")}
    assert len(want) == len(got)
    for signal, n, mae, bias in want:
        assert got[signal].n == n and math.isclose(got[signal].mae, mae, rel_tol=1e-9) and math.isclose(got[signal].bias, bias, rel_tol=1e-9, abs_tol=1e-12)
