"""Quality normalisation of raw readings: range, spikes, gaps, hold.

Held values are changed by valid readings alone, never by flags, so everything
is windows over (run, signal) in arrival order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import blocks
from tidegauge.functions.exprs import clip, finite

OK, CLAMPED, SUSPECT, STALE, IMPUTED, MISSING = range(6)
USABLE = SUSPECT
CLAMP_SLACK = 1e-6
GAP_FACTOR = 3.0


def gaps(ticks: DataFrame, interval: float, keys: Sequence[str] = (), order: str = "k", factor: float = GAP_FACTOR, span: float = blocks.SPAN) -> DataFrame:
    """One row a tick with ``gap_s`` (null first), ``discontinuity`` and ``segment``, a running count of discontinuities.

    A discontinuity is a gap over ``factor`` intervals or a step back in time.
    Ticks are dealt into blocks of ``span`` of ``order``, so one long run is many tasks.
    """
    w = Window.partitionBy(*keys, blocks.BLOCK).orderBy(order)
    carried = blocks.with_earlier(blocks.dealt(ticks, order, span), keys, last={"_ts": F.max_by("ts", order)})
    gap = carried.withColumn("gap_s", F.col("ts") - F.coalesce(F.lag("ts").over(w), "_ts")).drop("_ts")
    broken = gap.withColumn("discontinuity", F.coalesce((F.col("gap_s") > interval * factor) | (F.col("gap_s") < 0), F.lit(False)))
    one = F.col("discontinuity").cast("long")
    counted = blocks.with_earlier(broken, keys, total={"_count": F.sum(one)})
    running = F.col("_count") + F.sum(one).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("segment", running).drop("_count", blocks.BLOCK)


def counter_rate(rows: DataFrame, keys: Sequence[str] = ("signal",), order: str = "seq", value: str = "value", span: float = blocks.SPAN) -> DataFrame:
    """Add ``rate``: change a second of a counter since its last reading that was there; null on the first one, without time passed, and on a reset.

    Readings are dealt into blocks of ``span`` of ``order``; a block gets the last reading before it.
    """
    there = F.when(F.col(value).isNotNull(), F.struct(F.col("ts").alias("ts"), F.col(value).alias("value")))
    carried = blocks.with_earlier(blocks.dealt(rows, order, span), keys, last={"_last": F.max_by(there, F.when(F.col(value).isNotNull(), F.col(order)))})
    w = Window.partitionBy(*keys, blocks.BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = carried.withColumn("_last", F.coalesce(F.last(there, ignorenulls=True).over(w), "_last"))
    dt, dv = F.col("ts") - F.col("_last")["ts"], F.col(value) - F.col("_last")["value"]
    return before.withColumn("rate", F.when((dt > 0) & (dv >= 0), F.try_divide(dv, dt))).drop("_last", blocks.BLOCK)


def normalise(rows: DataFrame, specs: DataFrame, interval: float, keys: Sequence[str] = (), order: str = "k", factor: float = GAP_FACTOR, span: float = blocks.SPAN) -> DataFrame:
    """(keys, order, ts, gap_s, signal, value, quality) of every registered signal at every tick.

    ``rows`` has keys, order, ts, signal, value; ``specs`` has signal, lo, hi,
    max_rate, max_hold. Signals without a spec are dropped, missing ones added.
    A block of ``span`` of ``order`` gets the last value held before it, so an unbroken run is many tasks.
    """
    at = [*keys, order]
    times = gaps(rows.select(*at, "ts").distinct(), interval, keys, order, factor, span)
    # The specs are a registered, small set: one row holds them.
    registry = specs.agg(F.collect_list(F.struct(*specs.columns)).alias("_specs"))
    whole = times.crossJoin(F.broadcast(registry)).select(*times.columns, F.inline("_specs")).join(rows.select(*at, "signal", "value"), [*at, "signal"], "left")
    raw = finite("value")
    held = clip(raw, F.col("lo"), F.col("hi"))
    over = F.greatest(F.coalesce(F.col("lo") - raw, F.lit(0.0)), F.coalesce(raw - F.col("hi"), F.lit(0.0)))
    whole = whole.withColumns({"_clipped": held, "_over": over})
    there = F.when(F.col("_clipped").isNotNull(), F.struct(F.col("_clipped").alias("value"), F.col("ts").alias("ts")))
    run = [*keys, "signal", "segment"]
    whole = blocks.with_earlier(blocks.dealt(whole, order, span), run, last={"_last": F.max_by(there, F.when(F.col("_clipped").isNotNull(), F.col(order)))})
    w = Window.partitionBy(*run, blocks.BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_last", F.coalesce(F.last(there, ignorenulls=True).over(w), "_last"))
    whole = whole.withColumns({"_held": F.col("_last")["value"], "_held_ts": F.col("_last")["ts"]})
    dt = F.col("ts") - F.col("_held_ts")
    spike = F.coalesce((dt > 0) & (F.try_divide(F.abs(F.col("_clipped") - F.col("_held")), dt) > F.col("max_rate")), F.lit(False))
    here = F.col("_clipped").isNotNull()
    hold = F.coalesce(dt <= F.col("max_hold"), F.lit(False))
    quality = F.when(here & spike, SUSPECT).when(here & (F.col("_over") > CLAMP_SLACK), CLAMPED).when(here, OK).when(hold, STALE).otherwise(MISSING)
    value = F.when(here, F.col("_clipped")).when(hold, F.col("_held"))
    return whole.select(*at, "ts", "gap_s", "signal", value.alias("value"), quality.cast("int").alias("quality"))


def quality_counts(normal: DataFrame, by: Sequence[str] = ("signal",)) -> DataFrame:
    """Readings of each quality, by ``by``."""
    named = {"ok": OK, "clamped": CLAMPED, "suspect": SUSPECT, "stale": STALE, "missing": MISSING}
    return normal.groupBy(*by).agg(F.count("*").alias("samples"), *[F.count_if(F.col("quality") == q).alias(n) for n, q in named.items()])


def worst_quality(normal: DataFrame, at: Sequence[str] = ("k",)) -> DataFrame:
    """The worst quality of each tick and how many of its readings are usable."""
    return normal.groupBy(*at).agg(F.max("quality").alias("worst_quality"), F.count_if((F.col("quality") <= USABLE) & F.col("value").isNotNull()).alias("usable"))


def usable(normal: DataFrame) -> DataFrame:
    """Values that may be computed with; others null."""
    return normal.withColumn("value", F.when(F.col("quality") <= USABLE, F.col("value")))
