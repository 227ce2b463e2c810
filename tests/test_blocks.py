"""Windows dealt into blocks equal windows over whole series, whatever the size of a block."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import blocks
from tidegauge.operators import baselines, features, learning, quality, reports


def shown(df, columns=None):
    """Rows as text, floats to nine digits, in a fixed order."""
    names = columns or df.columns
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list) else v
    return sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def series(spark):
    """Two series, one with a null key, of uneven steps, long gaps and missing values."""
    r = np.random.default_rng(3)
    rows = []
    for key in ("x", None):
        t = 0.0
        for k in range(260):
            t += float(r.choice([5, 5, 5, 7, 60, 4_000], p=[0.5, 0.2, 0.15, 0.1, 0.04, 0.01]))
            rows.append((key, k, t, None if r.random() < 0.2 else float(r.integers(0, 100))))
    return spark.createDataFrame(rows, "key string, k long, ts double, value double").cache()


SIZES = [1, 7, 100, 100_000]


@pytest.mark.parametrize("size", SIZES)
def test_lags_and_spans(series, size):
    lags = (0.0, 15.0, 120.0)
    assert shown(features.with_lags(series, lags, 5.0, ["key"], block=size)) == shown(features._with_lags(series, lags, 5.0, ["key"], "k"))
    assert shown(features.span_stats(series, 90, ["key"], block=size)) == shown(features._span_stats(series, 90, ["key"], "k"))


@pytest.mark.parametrize("size", SIZES)
def test_baselines(series, size):
    got = baselines.forecasts(series, 60, 300, 120, 0, 100, ["key"], block=size)
    assert shown(got) == shown(baselines._forecasts(series, 60, 300, 120, 0, 100, ["key"], "k"), got.columns)


@pytest.mark.parametrize("size", [1, 40])
def test_coverage_readiness_volatility_quantile(series, size):
    buffer, span = features._rows(["key"], "k"), features.span(["key"], 600)
    reach = F.max("ts").over(buffer) - F.min("ts").over(buffer)
    plain = series.withColumn("coverage", F.count("value").over(buffer) / F.count("*").over(buffer) * F.least(F.lit(1.0), reach / 700.0))
    assert shown(features.coverage(series, 700.0, ["key"], block=size)) == shown(plain)
    assert shown(features.ready(series, 200.0, ["key"], block=size)) == shown(series.withColumn("ready", (F.count("*").over(buffer) >= 3) & (reach >= 200.0)))
    spread = F.when(F.count("value").over(span) >= 3, F.stddev_pop("value").over(span)).otherwise(0.0)
    assert shown(features.volatility(series, 600, 1.0, ["key"], block=size)) == shown(series.withColumn("volatility", F.greatest(spread, F.lit(1.0))))
    errors = series.filter("value IS NOT NULL").select("key", "ts", F.col("value").alias("abs_error"))
    before = F.sort_array(F.collect_list("abs_error").over(Window.partitionBy("key").orderBy("ts").rowsBetween(-20, -1)))
    got = reports.rolling_quantile(errors, 0.5, 20, 5, ["key"], "ts", block=size)
    assert shown(got) == shown(errors.withColumn("_b", before).withColumn("width", F.when(F.size("_b") >= 5, F.expr("(_b[(size(_b) - 1) div 2] + _b[size(_b) div 2]) / 2"))), got.columns)


@pytest.mark.parametrize("size", [1, 2, 5, 1_000])
def test_rows_of_one_time_are_peers(spark, size):
    """A frame by range holds all rows of the present time, and rows far back in small blocks of many equal times."""
    r = np.random.default_rng(size)
    rows = [("a", n, float(t), float(n % 13)) for n, t in enumerate(sorted(r.integers(0, 30, 120).tolist()))] + [("a", 500, None, 1.0)]
    df = spark.createDataFrame(rows, "key string, k long, ts double, value double")
    count = lambda d, by: d.withColumns({"n": F.count("*").over(features.span(by, 3)), "s": F.sum("value").over(Window.partitionBy(*by).orderBy("ts", "k").rowsBetween(-40, 0))})
    timed = df.filter("ts IS NOT NULL")
    got = blocks.within(df, ["key"], "k", 3, 40, count, size, span=4.0)
    assert shown(got.filter("ts IS NOT NULL")) == shown(count(timed, ["key"])) and got.count() == 121


def test_within_no_rows_and_no_key(spark):
    df = spark.createDataFrame([], "k long, ts double, value double")
    total = lambda d, by: d.withColumn("s", F.sum("value").over(features.span(by, 4)))
    assert blocks.within(df, [], "k", 4, 0, total).collect() == []
    some = spark.createDataFrame([(n, float(n), 1.0) for n in range(30)], "k long, ts double, value double")
    assert [r.s for r in blocks.within(some, [], "k", 4, 0, total, 3).orderBy("k").collect()] == [min(n + 1.0, 5.0) for n in range(30)]


def test_one_long_series_is_many_tasks(spark):
    df = spark.range(4_000).select(F.lit("a").alias("key"), F.col("id").alias("k"), (F.col("id") * 5.0).alias("ts"), F.rand(1).alias("value"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert features.span_stats(df, 60, ["key"], block=200).groupBy(F.spark_partition_id()).count().count() > 1
        assert baselines.forecasts(df, 60, 300, 120, 0, 1, ["key"], block=200).groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("span", [10.0, 333.0, 1e9])
def test_next_ticks_and_held_values(spark, series, span):
    asked = series.select("key", "k", (F.col("ts") + 33.0).alias("ts_target"))
    at = ["key", "k", "ts_target", "actual", "resolved_ts"]
    assert shown(baselines.resolve(asked, series, 5.0, ["key"], span), at) == shown(baselines.resolve(asked, series, 5.0, ["key"], 1e12), at)
    specs = spark.createDataFrame([("s", 0.0, 90.0, 1.5, 30.0)], "signal string, lo double, hi double, max_rate double, max_hold double")
    rows = series.filter("key = 'x'").withColumn("signal", F.lit("s"))
    assert shown(quality.normalise(rows, specs, 5.0, ["key"], span=span / 10)) == shown(quality.normalise(rows, specs, 5.0, ["key"], span=1e12))


def test_totals_and_places(spark, series):
    whole = Window.partitionBy("key")
    assert shown(blocks.with_totals(series, ["key"], n=F.count("*"), top=F.max("value"))) == shown(series.withColumns({"n": F.count("*").over(whole), "top": F.max("value").over(whole)}))
    first = F.when(F.row_number().over(whole.orderBy("k")) <= 20, F.col("value"))
    held = series.withColumn("_f", first)
    z = F.least(F.greatest((F.col("value") - F.avg("_f").over(whole)) / F.greatest(F.stddev_pop("_f").over(whole), F.lit(0.02)), F.lit(-5.0)), F.lit(5.0))
    plain = held.withColumn("value", F.when(F.col("value").isNotNull(), z)).drop("_f")
    assert shown(learning.warmed_up(series, ["value"], 20, ["key"])) == shown(plain)
