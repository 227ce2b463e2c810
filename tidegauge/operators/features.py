"""Feature windows over the last ``ROWS`` ticks of each series.

A frame is bounded in rows and in seconds at once. Frames of one partitioning
and order share a sort, so a select with many of them sorts once. Each operator
deals a series into blocks of ``block`` rows with what they look back on
(``blocks.within``), so a long series is many tasks; those with a leading
underscore work inside blocks that their caller has dealt.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.functions import blocks
from tidegauge.functions.exprs import slope

ROWS = 64


def _rows(keys: Sequence[str], order: str, n: int = ROWS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)


def span(keys: Sequence[str], seconds: float) -> WindowSpec:
    """Rows of the last whole ``seconds``, the present one included."""
    return Window.partitionBy(*keys).orderBy("ts").rangeBetween(-int(seconds), 0)


def scaled(value: Column | str, kind: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Fixed scaling by kind: flags to 0/1, rates and counters logarithmic, gauges to their range (100 wide where undeclared)."""
    value, kind, lo, hi = (F.col(c) if isinstance(c, str) else c for c in (value, kind, lo, hi))
    low = F.coalesce(lo, F.lit(0.0))
    width = F.coalesce(hi, low + 100.0) - low
    gauge = F.try_divide(value - low, F.when(width > 0, width).otherwise(F.lit(100.0)))
    return F.when(kind == "flag", (value > 0.5).cast("double")).when(kind.isin("rate", "counter"), F.log1p(F.greatest(value, F.lit(0.0))) / 9.0).otherwise(gauge)


def fill(keys: Sequence[str], order: str = "k", value: str = "value") -> Column:
    """The mean of the buffer, 0.5 where it is empty."""
    return F.coalesce(F.avg(value).over(_rows(keys, order)), F.lit(0.5))


def with_lags(rows: DataFrame, lags: Sequence[float], interval: float, keys: Sequence[str] = ("signal",), order: str = "k", block: int = blocks.ROWS) -> DataFrame:
    """Add ``lag_<seconds>``: the value so long ago.

    The nearest row within max(1.5 intervals, a quarter of the lag), the older
    of two; if it is null, the first usable of the six nearest within twice
    that; else the mean of the buffer. One collected frame serves all lags.
    """
    return blocks.within(rows, keys, order, 0, ROWS - 1, lambda r, by: _with_lags(r, lags, interval, by, order), block)


def _with_lags(rows: DataFrame, lags: Sequence[float], interval: float, keys: Sequence[str], order: str) -> DataFrame:
    buffer = rows.withColumns({"_buffer": F.collect_list(F.struct("ts", "value")).over(_rows(keys, order)), "_fill": fill(keys, order)})

    def lag_of(seconds: float) -> Column:
        tolerance = max(1.5 * interval, 0.25 * seconds)
        by_distance = F.array_sort(F.transform("_buffer", lambda r: F.struct(F.abs(r["ts"] - (F.col("ts") - seconds)).alias("d"), r["ts"].alias("t"), r["value"].alias("v"))))
        near = F.filter(F.slice(by_distance, 1, 6), lambda r: (r["d"] <= 2 * tolerance) & r["v"].isNotNull())
        return F.transform(F.array(by_distance), lambda b: F.when(b[0]["d"] <= tolerance, F.coalesce(b[0]["v"], F.get(near, F.lit(0))["v"])))[0]

    return buffer.withColumns({f"lag_{seconds:g}": F.coalesce(lag_of(seconds), F.col("_fill")) for seconds in lags}).drop("_buffer", "_fill")


def _change(lags: Sequence[float]) -> Column:
    return F.col(f"lag_{lags[0]:g}") - F.col(f"lag_{lags[-1]:g}")


def with_delta(rows: DataFrame, lags: Sequence[float], interval: float, keys: Sequence[str] = ("signal",), order: str = "k", block: int = blocks.ROWS) -> DataFrame:
    """Add the lags and ``delta``, the present value less that of the longest lag."""
    return with_lags(rows, lags, interval, keys, order, block).withColumn("delta", _change(lags))


def span_stats(rows: DataFrame, seconds: float, keys: Sequence[str] = ("signal",), order: str = "k", block: int = blocks.ROWS) -> DataFrame:
    """Add ``span_mean`` (else the fill), ``span_std`` (population; 0 of one or none) and ``span_slope`` (a minute; 0 of one or none)."""
    return blocks.within(rows, keys, order, seconds, ROWS - 1, lambda r, by: _span_stats(r, seconds, by, order), block)


def summary(rows: DataFrame, seconds: float, keys: Sequence[str] = ("signal",), order: str = "k", block: int = blocks.ROWS) -> DataFrame:
    """Add the columns of ``span_stats``, ``fill`` and ``anchor`` at once."""
    both = lambda by: {"fill": fill(by, order), "anchor": anchor(by, order)}
    return blocks.within(rows, keys, order, seconds, ROWS - 1, lambda r, by: _span_stats(r, seconds, by, order).withColumns(both(by)), block)


def _span_stats(rows: DataFrame, seconds: float, keys: Sequence[str], order: str) -> DataFrame:
    w = span(keys, seconds)
    return rows.withColumns({
        "span_mean": F.coalesce(F.avg("value").over(w), fill(keys, order)),
        "span_std": F.coalesce(F.stddev_pop("value").over(w), F.lit(0.0)),
        "span_slope": F.coalesce(slope("value", "ts", w), F.lit(0.0)) * 60.0,
    })


def coverage(rows: DataFrame, window_s: float, keys: Sequence[str] = ("signal",), order: str = "k", block: int = blocks.ROWS) -> DataFrame:
    """Add ``coverage``: usable share of the buffer's rows times the share of the window that they span."""
    def share(w: WindowSpec) -> Column:
        reach = F.max("ts").over(w) - F.min("ts").over(w)
        return F.count("value").over(w) / F.count("*").over(w) * F.least(F.lit(1.0), reach / window_s)

    return blocks.within(rows, keys, order, 0, ROWS - 1, lambda r, by: r.withColumn("coverage", share(_rows(by, order))), block)


def ready(rows: DataFrame, need_s: float, keys: Sequence[str] = ("signal",), order: str = "k", block: int = blocks.ROWS) -> DataFrame:
    """Add ``ready``: at least three rows that reach ``need_s`` back."""
    enough = lambda w: (F.count("*").over(w) >= 3) & (F.max("ts").over(w) - F.min("ts").over(w) >= need_s)
    return blocks.within(rows, keys, order, 0, ROWS - 1, lambda r, by: r.withColumn("ready", enough(_rows(by, order))), block)


def anchor(keys: Sequence[str] = ("signal",), order: str = "k", value: str = "value") -> Column:
    """The last usable value in the buffer, which may be old."""
    return F.last(value, ignorenulls=True).over(_rows(keys, order))


def volatility(rows: DataFrame, seconds: float, floor: float, keys: Sequence[str] = ("signal",), block: int = blocks.ROWS) -> DataFrame:
    """Add ``volatility``: population deviation of the span, 0 under three values, at least ``floor``."""
    spread = lambda w: F.greatest(F.when(F.count("value").over(w) >= 3, F.stddev_pop("value").over(w)).otherwise(0.0), F.lit(floor))
    return blocks.within(rows, keys, "ts", seconds, 0, lambda r, by: r.withColumn("volatility", spread(span(by, seconds))), block)


def time_features(ts: Column | str) -> list[Column]:
    """sin and cos of day and week, and the weekend flag, in UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.pmod(ts, F.lit(86400.0)) / 86400.0
    # 1 January 1970 was a Thursday, day 3 of a week that starts on Monday.
    weekday = F.pmod(F.floor(ts / 86400.0) + 3, F.lit(7))
    week = (weekday + day) / 7.0
    turn = lambda x: 2 * F.pi() * x
    return [F.sin(turn(day)).alias("sin_day"), F.cos(turn(day)).alias("cos_day"), F.sin(turn(week)).alias("sin_week"), F.cos(turn(week)).alias("cos_week"), (weekday >= 5).cast("double").alias("weekend")]


def vector_names(signals: Sequence[str], lags: Sequence[float], spans: Sequence[float], labels: Sequence[str]) -> list[str]:
    """The columns of ``vectors``: bias; of each signal lags, means, the longest span's deviation, slopes of the two longest, change; time; regime; coverage."""
    of = [*(f"lag_{x:g}" for x in lags), *(f"mean_{x:g}" for x in spans), f"std_{spans[-1]:g}", *(f"slope_{x:g}" for x in spans[-2:]), f"delta_{lags[-1]:g}"]
    return ["bias", *(f"{s}|{f}" for s in signals for f in of), *(f"time|{t}" for t in ("sin_day", "cos_day", "sin_week", "cos_week", "weekend")), *(f"regime|{x}" for x in labels), "meta|coverage"]


def mask(names: Sequence[str], target: str, spans: Sequence[float]) -> list[bool]:
    """Which columns a model of ``target`` uses: all of its own, of other signals the present value, a middle mean and the longest slope; bias, time, regime and coverage."""
    shared = {"lag_0", f"mean_{spans[len(spans) // 2]:g}", f"slope_{spans[-1]:g}"}
    parts = [n.partition("|") for n in names]
    return [not bar or head in (target, "time", "regime", "meta") or feature in shared for head, bar, feature in parts]


def schema_hash(names: Sequence[str], lags: Sequence[float], spans: Sequence[float], window_s: float) -> str:
    """A digest of what vectors consist of; vectors of another one are of no use to a model."""
    written = json.dumps([list(names), list(map(float, lags)), list(map(float, spans)), float(window_s)])
    return hashlib.sha256(written.encode()).hexdigest()[:16]


def vectors(rows: DataFrame, signals: Sequence[str], lags: Sequence[float], spans: Sequence[float], interval: float, window_s: float, regimes: DataFrame, labels: Sequence[str], order: str = "k", digits: int = 9, block: int = blocks.ROWS) -> DataFrame:
    """(k, vec): the vector of every tick over all ``signals`` (columns of ``vector_names``), of rows (signal, k, ts, value) and regimes (k, regime).

    Each signal's features come from windows over its blocks; one shuffle by
    tick puts them together in the order of ``signals``.
    """
    lag_names = [f"lag_{x:g}" for x in lags]

    def series(dealt: DataFrame, by: Sequence[str]) -> DataFrame:
        own = _with_lags(dealt, lags, interval, by, order).withColumns({"delta": _change(lags), "_fill": fill(by, order)})
        stats = {f"_mean_{x:g}": F.coalesce(F.avg("value").over(span(by, x)), F.col("_fill")) for x in spans}
        stats |= {"_std": F.coalesce(F.stddev_pop("value").over(span(by, spans[-1])), F.lit(0.0))}
        stats |= {f"_slope_{x:g}": F.coalesce(slope("value", "ts", span(by, x)), F.lit(0.0)) * 60.0 for x in spans[-2:]}
        w = _rows(by, order)
        stats |= {"_held": F.count("value").over(w), "_slots": F.count("*").over(w), "_reach": F.max("ts").over(w) - F.min("ts").over(w)}
        return own.withColumns(stats)

    part = F.array(*lag_names, *[f"_mean_{x:g}" for x in spans], "_std", *[f"_slope_{x:g}" for x in spans[-2:]], "delta")
    place = F.array_position(F.array(*map(F.lit, signals)), F.col("signal"))
    own = blocks.within(rows.filter(F.col("signal").isin(*signals)), ["signal"], order, max(spans), ROWS - 1, series, block)
    wide = own.groupBy(order).agg(
        F.sort_array(F.collect_list(F.struct(place.alias("place"), part.alias("part")))).alias("_parts"), F.first("ts").alias("ts"),
        (F.sum("_held") / F.sum("_slots") * F.least(F.lit(1.0), F.max("_reach") / window_s)).alias("_coverage"))
    label = F.col("regime")
    known = F.when(label.isin(*labels), label).otherwise(labels[0])
    joined = wide.join(regimes.select(order, "regime"), order, "left")
    vec = F.concat(F.array(F.lit(1.0)), F.flatten(F.transform("_parts", lambda p: p["part"])), F.array(*time_features("ts")), F.array(*[(known == x).cast("double") for x in labels]), F.array("_coverage"))
    return joined.select(order, F.transform(vec, lambda x: F.round(F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0))), digits) + F.lit(0.0)).alias("vec"))
