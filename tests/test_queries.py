"""Every query that has SQL, against DuckDB on the small tables."""

import math

import duckdb
import pytest

from tidegauge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert got == want


def test_flagship(spark, sf_dir):
    rows = catalogue.flagship(spark, sf_dir).collect()
    assert {r.arm for r in rows} == {"persistence", "moving_average", "ewma", "linear_trend"}


NOT_IN_SQL = sorted(set(catalogue.QUERIES) - set(catalogue.SQL))


@pytest.mark.parametrize("name", NOT_IN_SQL)
def test_without_sql(spark, sf_dir, name):
    rows = catalogue.QUERIES[name](spark, sf_dir).collect()
    assert rows
    if name == "experiment_core":
        by = {}
        for r in rows:
            by.setdefault(r.signal, {})[r.arm] = r
        # All arms of a signal are judged on the same rows.
        assert all(len({a.n for a in arms.values()}) == 1 and arms["persistence"].skill == 0 for arms in by.values())
    if name == "adaptation_replay":
        assert {r.decision for r in rows} <= {None, "promoted", "rejected", "skipped", "rolled_back"} and all((r.decision is None) == (r.reason is None) for r in rows)
    if name == "rls_online":
        plain_rls(rows)
    if name.startswith("drift_"):
        assert all(r.statistic is None or r.statistic >= 0 for r in rows)


def plain_rls(rows):
    """Predictions exist for every row, in the order of each signal's targets, and the last ones beat the first."""
    for signal in {r.signal for r in rows}:
        own = sorted((r for r in rows if r.signal == signal), key=lambda r: r.ts_target)
        assert own[0].predicted == 0.0 and all(math.isfinite(r.predicted) for r in own)
