"""Questions, answers, notes; the test of two forecasters; counters and resolution with awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import answers, baselines, evidence, features, learning, quality, regime, reports, store


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<double>' if isinstance(v, list) else 'double'}" for k, v in (values or {"x": 1.0}).items())
    return spark.createDataFrame([tuple((values or {"x": 1.0}).values())], fields).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("Why was the last forecast wrong?", "forecast_error"), ("How accurate are you?", "forecast_error"), ("When does it run out?", "battery"), ("Why is it hot?", "why_change"), ("Is this unusual?", "anomaly"),
    ("Did you learn from it?", "adaptation"), ("What will it be next?", "forecast"), ("Is memory climbing?", "trend"), ("ok", "status"), ("", "status"),
])
def test_intents(spark, text, want):
    assert one(spark, answers.intent("t"), t=text) == want


def test_focus_takes_the_longest_label(spark):
    labels = {"gpu.util_pct": "GPU", "gpu.temp": "GPU temperature"}
    focus = lambda t, **o: one(spark, answers.focus("t", labels, **o), t=t)
    assert focus("how is the gpu temperature") == "gpu.temp" and focus("gpu?") == "gpu.util_pct" and focus("RAM") == "mem.used_pct"
    assert focus("ram", available=["gpu.temp"]) is None and focus("nothing") is None


@pytest.mark.parametrize(("text", "want"), [
    ("Battery 71.0% now, down 11% in 42 min; likely 63.0-69.0%.", [71.0, 11.0, 42.0, 63.0, -69.0]), ("1,234.5 and -3", [1234.5, -3.0]), ("open 24/7, top 1 of v001, top 12", []),
    ("TOP 3, 2nd, 21st, top 2", [21.0, 2.0]), ("top 1,204 of 1,2,3", [1.0, 2.0, 3.0]), ("124/7 at +24/7", [124.0, 24.0]), ("", []),
])
def test_numbers(spark, text, want):
    assert one(spark, answers.numbers("t"), t=text) == want


@pytest.mark.parametrize(("said", "facts", "want"), [
    ([48.0], [48.23], 1), ([11.0], [-11.0], 1), ([100.0], [94.5], 1), ([94.5], [100.0], 1), ([106.0], [100.0], 1), ([94.0], [88.0], 0), ([99.0], [42.0], 0), ([0.1], [0.0], 1), ([5.0], [float("nan"), float("inf")], 0),
    ([], [1.0], 0), ([1.0], [], 0),
])
def test_grounding(spark, said, facts, want):
    assert one(spark, answers.grounded(F.col("s"), F.col("f")), s=said, f=facts) == want


def style(spark, text, **options):
    checks, found = answers.style_violations("t", **options)
    r = spark.createDataFrame([(text,)], "t string").select(checks.alias("n"), found.alias("v")).first()
    return r.n, r.v


def test_style(spark):
    assert style(spark, "CPU is 48.2%. Fine. Ok. Yes. No.", max_sentences=4) == (2, ["too_long(5>4)"])
    assert style(spark, "It is fine. CPU 4%.") == (2, ["no_number_in_first_sentence"])
    yes = F.lit(True)
    assert style(spark, "63% soon", forecasts=F.array(F.lit(63.0))) == (3, ["forecast_without_uncertainty"])
    assert style(spark, "likely 63%", forecasts=F.array(F.lit(63.0))) == (3, []) and style(spark, "now 20%", forecasts=F.array(F.lit(63.0))) == (2, [])
    assert style(spark, "20% left", projection=yes)[1] == ["battery_without_duration"] and style(spark, "20%, 2 h left", projection=yes)[1] == []
    assert style(spark, "5% due to a build", drivers=yes)[1] == ["asserted_causation"] and style(spark, "5% due to, or correlated with", drivers=yes)[1] == []
    assert style(spark, "5% usage", vocabulary={"usage": "load"})[1] == ["vocabulary(usage->load)"]
    assert style(spark, "5%", required=F.array(F.lit("normal"), F.lit(""))) == (4, ["missing_rule_word(normal)"])
    assert style(spark, "")[1] == ["no_number_in_first_sentence"]


@pytest.mark.parametrize(("text", "want"), [
    ("That's normal for me when I compile", ("build", "normal", "normal")), ("this is not normal while gaming", ("gpu_heavy", "concerning", "unusual")), ("no problem", ("*", "concerning", "unusual")),
    ("expected on battery", ("battery_constrained", "normal", "normal")), ("hello", None), ("  ", None),
])
def test_rules_of_notes(spark, text, want):
    rule = one(spark, answers.inferred_rule("t"), t=text)
    assert (rule and (rule.regime, rule.verdict, rule.required_word)) == want


def test_verbosity(spark):
    said = lambda a, b, n=4: one(spark, answers.verbosity(F.lit(a), F.lit(b), n))
    assert (said(0, 3), said(0, 2), said(5, 0), said(4, 0), said(0, 9, 6), said(9, 0, 2)) == (5, 4, 3, 4, 6, 2)


def plain_dm(a, b):
    d = np.abs(a) - np.abs(b)
    n, c = len(d), d - d.mean()
    lags = max(1, int(n ** (1 / 3)))
    var = (c * c).mean() + sum(2 * (1 - k / (lags + 1)) * (c[k:] * c[:-k]).mean() for k in range(1, lags + 1))
    stat = d.mean() / math.sqrt(var / n)
    return stat, math.erfc(abs(stat) / math.sqrt(2))


@pytest.mark.parametrize("n", [29, 30, 64, 700])
def test_diebold_mariano(spark, n):
    r = np.random.default_rng(n)
    a, b = r.standard_normal(n), r.standard_normal(n) * 1.3 + 0.1
    rows = [(arm, "s", 60.0, float(i), float(i), float(e)) for arm, es in (("a", a), ("b", b)) for i, e in enumerate(es)]
    df = spark.createDataFrame(rows, "arm string, signal string, horizon double, ts double, ts_target double, error double")
    got = reports.diebold_mariano(df, "a", "b").first()
    if n < 30:
        assert got.statistic is None and got.p_value is None
    else:
        stat, p = plain_dm(a, b)
        assert math.isclose(got.statistic, stat, rel_tol=1e-9) and math.isclose(got.p_value, p, abs_tol=1e-6)


def test_counter_keeps_its_last_reading(spark):
    rows = [(1, 0.0, 1000.0), (2, 10.0, 2000.0), (3, 20.0, None), (4, 30.0, 3000.0), (5, 40.0, 500.0), (6, 50.0, 1500.0), (7, 50.0, 1600.0)]
    df = spark.createDataFrame([("c", *r) for r in rows], "signal string, seq long, ts double, value double")
    assert [r.rate for r in quality.counter_rate(df).orderBy("seq").collect()] == [None, 100.0, None, 50.0, None, 100.0, None]


def test_repeated_predictions_stay_apart(spark):
    actuals = spark.createDataFrame([("s", 10.0 * n, float(n)) for n in range(5)], "signal string, ts double, value double")
    asked = spark.createDataFrame([("s", 20.0), ("s", 20.0), ("s", 900.0)], "signal string, ts_target double")
    assert sorted((r.actual is None, r.actual) for r in baselines.resolve(asked, actuals, 10.0).collect()) == [(False, 2.0), (False, 2.0), (True, None)]
    twice = actuals.union(actuals)
    assert baselines.seasonal_naive(twice, 10.0, 20.0, 2.0).count() == 10


def test_categories(spark):
    names = ["GCC", "cargo-build", "Firefox", "python3.12", "nvim", "dockerd", "kworker/1", "Xorg", "sshd", "vscode"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(evidence.category("n")).collect()]
    assert got == ["build", "build", "browser", "ml", "editor", "container", "system", None, None, "editor"]


def test_vector_columns():
    signals = [f"s{n}" for n in range(19)]
    names = features.vector_names(signals, (0, 60, 300), (60, 300, 900), regime.LABELS)
    assert len(names) == len(set(names)) == 1 + 19 * 10 + 5 + 9 + 1
    kept = [n for n, k in zip(names, features.mask(names, "s3", (60, 300, 900)), strict=True) if k]
    assert len(kept) == 1 + 10 + 18 * 3 + 15 and "s4|mean_300" in kept and "s4|mean_60" not in kept
    one_, other = (features.schema_hash(names, (0, 60), s, 900) for s in ((60,), (61,)))
    assert one_ != other and len(one_) == 16


def test_trigger_order(spark):
    t = lambda *a, **o: one(spark, learning.trigger(*map(F.lit, a), **o))
    assert t(True, 240, 0.0, 9e9, 9e9) == "drift" and t(False, 240, 0.0, 0.0, 0.0) == "periodic_samples" and t(False, 1, None, 0.0, 0.0) == "periodic_time"
    assert t(False, 0, 0.0, 9e9, 60.0) == "error" and t(False, 0, None, 0.0, 0.0) is None and t(True, 0, 0.0, 0.0, 0.0, policies=("error",)) is None


def test_logs(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, kind string, end string")
    log = spark.createDataFrame([(1, 1.0, "x"), (1, 2.0, "y")], "id long, at double, end string")
    assert sorted((r.id, r.end) for r in store.with_log(rows, log, "id", ["at"], ["end"]).collect()) == [(1, "y"), (2, None)]
    assert [r.id for r in store.listed(rows, [F.desc("id")], 5, kind=None).collect()] == [2, 1] and store.reference_now(log.filter("id > 9").withColumnRenamed("at", "ts"), 7.0).first().now == 7.0
