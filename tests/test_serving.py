"""Replies, personas, sources, retention and stored datasets."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import replies, store
from tidegauge.sources import collect, datasets, scenarios


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_durations_and_values(spark):
    said = [one(spark, replies.duration(F.lit(float(s)))) for s in (-30, 89, 90, 5_399, 5_400, 172_800)]
    assert said == ["30 s", "89 s", "2 min", "90 min", "1.5 h", "2.0 days"]
    assert one(spark, replies.one_decimal(F.lit(None).cast("double"), "%")) == "n/a" and one(spark, replies.one_decimal(F.lit(2.26), "%")) == "2.3%"


def test_forecasts_name_their_signal_and_range(spark):
    x = F.lit(5.0)
    assert one(spark, replies.forecast_clause("CPU", 300, x, F.lit(4.0), F.lit(6.0), "%")) == "CPU is expected at 5.0% in 5 min, likely 4.0% to 6.0%."
    assert "not known" in one(spark, replies.forecast_clause("CPU", 300, x, F.lit(None).cast("double"), F.lit(6.0)))
    assert one(spark, replies.forecast_clause("CPU", 300, F.lit(None).cast("double"))) is None


def test_battery_clause_takes_the_first_level_known(spark):
    none, yes = F.lit(None).cast("double"), F.lit(1.0)
    assert "30 minutes" in one(spark, replies.battery_clause(none, none, {20: none, 10: F.lit(30.0), 0: F.lit(50.0)}))
    assert "AC power" in one(spark, replies.battery_clause(yes, none, {20: F.lit(30.0)}))
    assert "0.250%/min" in one(spark, replies.battery_clause(F.lit(0.0), F.lit(-0.25), {20: none})) and one(spark, replies.battery_clause(none, none, {20: none})) is None


@pytest.mark.parametrize("intent, budget, have, want", [
    ("status", 4, "now change forecast", "now change forecast"), ("status", 2, "now change forecast", "now change"), ("status", 2, "now change rule", "now rule"),
    ("status", 1, "now rule", "now"), ("status", 1, "change rule", "rule"), ("forecast", 4, "now change forecast", "now forecast change"), ("trend", 4, "now rule", "now"),
    ("adaptation", 3, "now", "none"), ("forecast_error", 3, "now accuracy event", "accuracy now event"), ("anything else", 4, "now rule", "now rule")])
def test_clauses_in_order_and_number(spark, intent, budget, have, want):
    clauses = {c: F.lit(c) for c in have.split()}
    assert one(spark, replies.assembled(F.lit(intent), clauses, F.lit("none"), budget)) == want


def test_notes_and_vocabulary(spark):
    assert one(spark, replies.assembled(F.lit("status"), {"now": F.lit("the now")}, F.lit("-"), 2, F.lit("note"), {"the": "a"})) == "a now note"


def test_replies_fall_back(spark):
    rows = spark.createDataFrame([(1, "  CPU is 50.2%. "), (2, "It is 99"), (3, "  "), (4, None), (5, "fine")], "id int, said string")
    text, reason, share = replies.served("said", F.lit("rendered"), F.array(F.lit(50.0), F.lit(None).cast("double")))
    got = [tuple(r) for r in rows.select(text, reason, share).orderBy("id").collect()]
    assert got == [("CPU is 50.2%.", None, 1.0), ("rendered", "ungrounded_numbers", 0.0), ("rendered", "empty_generation", 1.0), ("rendered", "empty_generation", 1.0), ("fine", None, 1.0)]


def test_persona(spark):
    rows = [(1, 1.0, "note", "That's normal for me, cargo build", None), (2, 2.0, "note", "hello", None), (3, 3.0, "label", "hello", None), (4, 4.0, "note", "That's normal for me, cargo build", None), (5, 5.0, "note", None, None)]
    rows += [(10 + n, 9.0, "forecast_useful", None, label) for n, label in enumerate(["no", "no", None, "YES", "no"])]
    p = replies.persona(spark.createDataFrame(rows, "id long, ts double, kind string, text string, label string")).first()
    assert [(r.regime, r.verdict) for r in p.rules] == [("build", "normal")] and p.context == ["hello"]
    assert (p.useful, p.useless, p.sentences, p.revision) == (1, 4, 5, 3)
    empty = replies.persona(spark.createDataFrame([], "id long, ts double, kind string, text string, label string")).first()
    assert (empty.rules, empty.context, empty.useful, empty.useless, empty.sentences, empty.revision) == ([], [], 0, 0, 4, 0)


def plain_states(ticks, interval):
    """What a collector does, tick by tick."""
    out, failed, until, sampled, value = [], 0, 0.0, 0.0, None
    for now, ok, v in ticks:
        if now < until:
            out.append(("quarantined", None))
        elif interval and now - sampled < interval:
            out.append(("reused", value))
        elif ok:
            failed, until, sampled = 0, 0.0, now
            value = v if v is not None else value
            out.append(("read", v))
        else:
            failed += 1
            until = now + {3: 5.0, 4: 15.0, 5: 60.0}.get(failed, 300.0) if failed >= 3 else until
            out.append(("failed", None))
    return out


@pytest.mark.parametrize("interval", [0.0, 30.0])
def test_quarantine(spark, interval):
    r = random.Random(4)
    ticks = {s: [(100.0 + 5 * n, r.random() < share, r.choice([None, 1.0, 2.0])) for n in range(300)] for s, share in (("a", 0.9), ("b", 0.2))}
    rows = [(s, t, n, ok, v) for s, own in ticks.items() for n, (t, ok, v) in enumerate(own)]
    got = collect.read_all(spark.createDataFrame(rows, "source string, ts double, seq long, ok boolean, value double"), interval).collect()
    for s, own in ticks.items():
        assert [(x.state, x.value) for x in sorted((x for x in got if x.source == s), key=lambda x: x.seq)] == plain_states(own, interval)


def test_registry_takes_the_first_available_source(spark):
    rows = [("a", 1, False, "cpu", "%", 0.0), ("b", 2, True, "cpu", "%", None), ("c", 3, True, "cpu", "%", None), ("d", 4, True, "cpu", "MHz", 0.0)]
    got = collect.merged(spark.createDataFrame(rows, "source string, place int, available boolean, signal string, unit string, lo double"), fields=("unit", "lo")).collect()
    assert [tuple(x) for x in got] == [("cpu", "b", "%", None, 1)]


def test_top_features_and_series(spark):
    got = store.top_features(spark.createDataFrame([([1.0, -3.0, 3.0, 0.0],)], "vec array<double>"), ["a", "b", "c", "d"], 3).first()
    assert [tuple(f) for f in got.features] == [("b", -3.0), ("c", 3.0), ("a", 1.0)]
    rows = spark.createDataFrame([(k, float(k), "s", float(k)) for k in range(1080)], "k long, ts double, signal string, value double")
    points = store.series(rows, ["s", "unknown"], 1079.0, 5_000.0, 50).orderBy("k").collect()
    assert len(points) <= 50 and [p.k for p in points[:3]] == [0, 22, 44] and all(p.unknown is None for p in points)
    assert store.series(rows.filter("false"), ["s"], 0.0, 10.0, 50).count() == 0


def test_export_load_and_stored_runs(spark, tmp_path):
    samples = spark.createDataFrame([(1, "r1", 10.0, "live", None, 1.0), (2, "r1", 20.0, "live", 10.0, 1.0), (3, "r2", 30.0, "live", None, 1.0), (4, "r1", 40.0, "live", None, 1.0)], "sample_id long, run string, ts double, origin string, gap_s double, collect_ms double")
    values = spark.createDataFrame([(1, "cpu", 5.0, 0), (1, "mem", None, 5), (2, "cpu", 7.0, 2), (3, "cpu", 9.0, 0)], "sample_id long, signal string, value double, quality int")
    signals = spark.createDataFrame([("cpu", "%", "gauge")], "name string, unit string, kind string")
    datasets.export(samples, values, signals, f"{tmp_path}/set", run="r1", until=30.0)
    datasets.load(spark, f"{tmp_path}/set", "again", f"{tmp_path}/db")
    datasets.load(spark, f"{tmp_path}/set", "other", f"{tmp_path}/db")
    got = sorted(((r.ts, r.signal, r.value, r.quality) for r in scenarios.dataset(spark, f"db:{tmp_path}/db?run=again").collect()), key=repr)
    assert got == [(10.0, "cpu", 5.0, 0), (10.0, "mem", None, 5), (20.0, "cpu", 7.0, 2)]
    assert scenarios.dataset(spark, f"db:{tmp_path}/db").count() == 6


def test_retention_cascades(spark):
    samples = spark.createDataFrame([(1, 1.0), (2, 5.0)], "sample_id long, ts double")
    kept, readings, windows, removed = store.retained_with(samples, spark.createDataFrame([(1,), (2,), (2,)], "sample_id long"), samples, 5.0)
    assert kept.count() == 1 and readings.count() == 2 and windows.count() == 1 and removed.first().removed == 1
