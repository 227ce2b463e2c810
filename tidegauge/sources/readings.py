"""Readings from an event table, and regular ticks made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Ticks of a block of the time axis.
BLOCK_TICKS = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", start, ts) / F.lit(1e6)


def readings(spark: SparkSession, sf_dir: str, runs: int = 4) -> DataFrame:
    """(seq, run, signal, ts, value): one row an event, in arrival order ``seq``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % runs).alias("run"), F.col("event_type").alias("signal"), epoch_seconds("ts").alias("ts"), "value")


def ticks(rows: DataFrame, step: float, dense: bool = True) -> DataFrame:
    """(signal, k, ts, value): the mean value of each signal in each tick of ``step`` seconds, null where it has none.

    With ``dense`` every tick from the first to the last is there, without it
    only ticks in which any signal was read. Every signal has a row a tick.
    """
    cells = rows.groupBy("signal", F.floor(F.col("ts") / step).alias("k")).agg(F.avg("value").alias("value"))
    # Signals are a registered, small set: one row holds them and the ends of the time axis.
    ends = cells.agg(F.min("k").alias("a"), F.max("k").alias("b"), F.sort_array(F.collect_set("signal")).alias("signals")).filter("a IS NOT NULL")
    if dense:
        # Blocks of ticks first, then the ticks of each block, so that no row or task holds the whole axis.
        first, last = F.greatest("a", F.col("block") * BLOCK_TICKS), F.least("b", F.col("block") * BLOCK_TICKS + (BLOCK_TICKS - 1))
        dealt = ends.select(F.explode(F.sequence(F.floor(F.col("a") / BLOCK_TICKS), F.floor(F.col("b") / BLOCK_TICKS))).alias("block"), "a", "b", "signals").repartition("block")
        times = dealt.select(F.explode(F.sequence(first, last)).alias("k"), "signals")
    else:
        times = cells.select("k").distinct().crossJoin(F.broadcast(ends.select("signals")))
    grid = times.select("k", F.explode("signals").alias("signal"))
    return grid.join(cells, ["signal", "k"], "left").select("signal", "k", (F.col("k") * F.lit(float(step))).alias("ts"), "value")


READINGS_SQL = "readings AS (SELECT event_id AS seq, user_id % 4 AS run, event_type AS signal, epoch_us(ts) / 1e6 AS ts, value FROM events)"


def ticks_sql(step: float, dense: bool = True) -> str:
    """DuckDB form of ``ticks`` over ``readings``: the CTEs cells, times and grid."""
    times = "SELECT unnest(range(a, b + 1)) AS k FROM (SELECT min(k) AS a, max(k) AS b FROM cells)" if dense else "SELECT DISTINCT k FROM cells"
    return f"""{READINGS_SQL},
cells AS (SELECT signal, CAST(floor(ts / {step}) AS BIGINT) AS k, avg(value) AS value FROM readings GROUP BY ALL),
times AS ({times}),
grid AS (SELECT s.signal, t.k, t.k * CAST({step} AS DOUBLE) AS ts, c.value
         FROM times t CROSS JOIN (SELECT DISTINCT signal FROM cells) s LEFT JOIN cells c ON c.signal = s.signal AND c.k = t.k)"""
