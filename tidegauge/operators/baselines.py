"""Baseline forecasts and their resolution against what came later."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import blocks
from tidegauge.functions.exprs import clip, slope
from tidegauge.operators.features import ROWS, anchor, span

ARMS = ("persistence", "moving_average", "ewma", "linear_trend")


def forecasts(rows: DataFrame, horizon: float, window_s: float, half_life: float, lo: float, hi: float, keys: Sequence[str] = ("signal",), order: str = "k", block: int = blocks.ROWS) -> DataFrame:
    """(rows, anchor, one column for each of ARMS, ts_target): what each baseline expects ``horizon`` seconds on.

    The exponential weights run over the whole buffer, moving average and trend
    over the last ``window_s`` seconds. A series is worked on in blocks of ``block`` rows.
    """
    return blocks.within(rows, keys, order, window_s, ROWS - 1, lambda r, by: _forecasts(r, horizon, window_s, half_life, lo, hi, by, order), block)


def _forecasts(rows: DataFrame, horizon: float, window_s: float, half_life: float, lo: float, hi: float, keys: Sequence[str], order: str) -> DataFrame:
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - ROWS, 0)
    rate = math.log(2.0) / half_life
    base = rows.withColumns({"anchor": anchor(keys, order), "_n": F.count("value").over(frame)})
    aged = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("ts", "value"))).over(frame)
    base = base.withColumn("_buffer", aged)
    weight = lambda r: F.exp(-F.lit(rate) * (F.col("ts") - r["ts"]))
    total = lambda f: F.aggregate("_buffer", F.lit(0.0), lambda s, r: s + f(r))
    ewma = F.try_divide(total(lambda r: weight(r) * r["value"]), total(weight))
    recent = span(keys, window_s)
    n_recent = F.count("value").over(recent)
    trend = F.when(n_recent >= 3, slope("value", "ts", recent)).otherwise(slope("value", "ts", frame))
    base = base.withColumns({
        "persistence": F.col("anchor"),
        "moving_average": clip(F.coalesce(F.avg("value").over(recent), F.col("anchor")), lo, hi),
        "linear_trend": F.when(F.col("_n") < 3, F.col("anchor")).otherwise(F.coalesce(clip(F.col("anchor") + trend * horizon, lo, hi), F.col("anchor"))),
    })
    base = base.withColumn("ewma", F.when(F.col("_n") == 1, F.col("anchor")).otherwise(clip(F.coalesce(ewma, F.col("anchor")), lo, hi)))
    return base.withColumn("ts_target", F.col("ts") + horizon).drop("_buffer", "_n")


def seasonal_naive(rows: DataFrame, horizon: float, period: float = 86400.0, tolerance: float = 60.0, keys: Sequence[str] = ("signal",)) -> DataFrame:
    """Add ``seasonal_naive``: the value at target minus ``period``, nearest within ``tolerance``; null before a period has passed.

    An equi-join on time buckets of the tolerance and their neighbours, not a range join.
    """
    width = max(2 * tolerance, 1.0)
    past = rows.select(*keys, F.col("ts").alias("_ts"), F.col("value").alias("_value"), F.floor(F.col("ts") / width).alias("_bucket"))
    want = F.col("ts") + horizon - period
    # Rows may repeat each other, so each gets a number.
    asked = rows.withColumns({"_want": want, "_row": F.monotonically_increasing_id()}).withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_want") / width) + d)))
    distance = F.abs(F.col("_ts") - F.col("_want"))
    joined = asked.join(past, [*keys, "_bucket"], "left").withColumn("_d", F.when(distance <= tolerance, F.struct(distance.alias("d"), F.col("_ts").alias("t"), F.col("_value").alias("v"))))
    return joined.groupBy("_row", *rows.columns).agg(F.min("_d").alias("_d")).withColumn("seasonal_naive", F.col("_d.v")).drop("_d", "_row")


def resolve(predictions: DataFrame, actuals: DataFrame, interval: float, keys: Sequence[str] = ("signal",), span: float = blocks.SPAN) -> DataFrame:
    """Add ``actual`` and ``resolved_ts`` to predictions with ``ts_target``.

    At the first tick at or after the target, the usable value nearest to it
    among that tick and those within the tolerance before it (ties: the later);
    if there is none, the first usable value within the tolerance after it.
    Ticks are dealt into buckets of the tolerance, and a prediction looks into
    the neighbouring ones: the join is on equality and scales with its matches.
    A prediction whose target no tick has reached stays unresolved.
    """
    tolerance = max(1.5 * interval, 2.0)
    # The tick that follows each: the one before it in falling time, from its own block or an earlier one.
    falling = blocks.dealt(actuals.select(*keys, "ts", "value", (-F.col("ts")).alias("_back")), "_back", span)
    carried = blocks.with_earlier(falling, keys, last={"_next": F.max_by("ts", "_back")})
    following = F.coalesce(F.lag("ts").over(Window.partitionBy(*keys, blocks.BLOCK).orderBy("_back")), F.col("_next"))
    ticks = carried.select(*keys, F.col("ts").alias("_ts"), F.col("value").alias("_value"), following.alias("_following"), F.floor(F.col("ts") / tolerance).alias("_bucket"))
    asked = predictions.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("ts_target") / tolerance) + d)))
    here = F.col("_ts").between(F.col("ts_target") - tolerance, F.col("ts_target") + tolerance)
    joined = asked.join(ticks, [*keys, "_bucket"], "left")
    row = F.struct(F.col("_ts").alias("t"), F.col("_value").alias("v"))
    usable = here & F.col("_value").isNotNull()
    # Ticks of a tolerance on either side are few: 2 * tolerance / interval.
    found = joined.groupBy("_row", *predictions.columns).agg(
        F.max(F.when(usable & (F.col("_ts") < F.col("ts_target")), row)).alias("_before"),
        F.max(F.when(here & (F.col("_ts") < F.col("ts_target")), F.struct("_ts", "_following"))).alias("_last"),
        F.min(F.when(here & (F.col("_ts") >= F.col("ts_target")), row)).alias("_first"),
        F.min(F.when(usable & (F.col("_ts") >= F.col("ts_target")), row)).alias("_after"))
    before, first, after = F.col("_before"), F.col("_first"), F.col("_after")
    later = first["v"].isNotNull() & (before.isNull() | (F.abs(first["t"] - F.col("ts_target")) <= F.abs(before["t"] - F.col("ts_target"))))
    # The first tick at or after the target may lie beyond the tolerance; then only what came before counts.
    reached = F.coalesce(first["t"], F.col("_last")["_following"])
    chosen = F.when(reached.isNull(), None).when(later, first).when(before.isNotNull(), before).otherwise(after)
    seen = F.when(reached.isNull(), None).when(first["v"].isNotNull() | before.isNotNull(), reached).otherwise(after["t"])
    return found.withColumns({"actual": chosen["v"], "resolved_ts": seen}).drop("_before", "_last", "_first", "_after", "_row")


def scored(resolved: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """Long form: (…, arm, predicted, error, abs_error) of resolved predictions; unusable ones are left out."""
    kept = [c for c in resolved.columns if c not in arms]
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("predicted")) for a in arms]))
    rows = resolved.filter("actual IS NOT NULL").select(*kept, pairs.alias("_p")).select(*kept, "_p.*").filter("predicted IS NOT NULL")
    return rows.withColumns({"error": F.col("predicted") - F.col("actual"), "abs_error": F.abs(F.col("predicted") - F.col("actual"))})


def extras(predicted: Column, anchor_: Column, volatility: Column, limit: float = 8.0) -> Column:
    """A baseline as a model input: its distance from the anchor in volatilities, held within ``limit``, 0 if there is none."""
    return F.coalesce(clip(F.try_divide(predicted - anchor_, volatility), -limit, limit), F.lit(0.0))
