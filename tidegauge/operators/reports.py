"""Accuracy reports over scored forecasts: (arm, signal, horizon, ts_target, predicted, actual, error, abs_error[, lo, hi])."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import blocks
from tidegauge.functions.exprs import clip, erfc
from tidegauge.operators import order_stats
from tidegauge.session import materialised

SCOPE = ("signal", "horizon")


def _finite_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("predicted IS NOT NULL AND actual IS NOT NULL AND NOT isnan(predicted) AND NOT isnan(actual)")


def metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mae, rmse, bias, p90 and max of the absolute error, and smape, by ``by``; p90 is exact for groups of any size."""
    size = (F.abs("predicted") + F.abs("actual")) / 2
    # Written once: the sums and the order statistic read it.
    held = materialised(_finite_rows(rows).select(*by, "predicted", "actual", "error", "abs_error"), "scored")
    sums = held.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("error").alias("bias"),
        F.max("abs_error").alias("max_abs"), (100 * F.avg(F.when(size > 1e-6, F.col("abs_error") / size))).alias("smape"))
    p90 = order_stats.quantiles(held, by, "abs_error", [0.9], order_stats.FEW).select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("quantiles")[0].alias("p90"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return sums.join(p90, same, "left").select(*by, "n", "mae", "rmse", "bias", "p90", "max_abs", "smape")


def interval_quality(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coverage and mean width over rows with both bounds."""
    both = rows.filter("lo IS NOT NULL AND hi IS NOT NULL AND actual IS NOT NULL")
    inside = (F.col("actual") >= F.col("lo")) & (F.col("actual") <= F.col("hi"))
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("mean_width"))


def with_skill(report: DataFrame, scope: Sequence[str], reference: str = "persistence") -> DataFrame:
    """Add ``ref_mae`` and ``skill`` = 1 - mae / ref_mae (null without a reference or at a zero one)."""
    ref = F.max(F.when(F.col("arm") == reference, F.col("mae"))).over(Window.partitionBy(*scope))
    rows = report.withColumn("ref_mae", ref)
    return rows.withColumn("skill", F.when(F.col("ref_mae") > 0, 1 - F.try_divide(F.col("mae"), F.col("ref_mae"))))


def over_time(rows: DataFrame, windows: int, scope: Sequence[str] = SCOPE, least: int = 20) -> DataFrame:
    """mae and n of each arm in ``windows`` equal parts of the scope's time; parts with under ``least`` rows of all arms are left out."""
    w = Window.partitionBy(*scope)
    step = (F.max("ts_target").over(w) + 1e-6 - F.min("ts_target").over(w)) / windows
    part = F.least(F.floor((F.col("ts_target") - F.min("ts_target").over(w)) / step), F.lit(windows - 1)).cast("int")
    parts = _finite_rows(rows).withColumn("part", part)
    grouped = parts.groupBy(*scope, "arm", "part").agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"))
    return grouped.withColumn("_all", F.sum("n").over(Window.partitionBy(*scope, "part"))).filter(F.col("_all") >= least).drop("_all")


def comparison(report: DataFrame, arms: Sequence[str], scope: Sequence[str] = SCOPE) -> DataFrame:
    """One row a scope: each arm's mae, the best arm, and whether the arms' row counts differ by over twice."""
    wide = report.groupBy(*scope).pivot("arm", list(arms)).agg(F.first("mae"))
    best = report.groupBy(*scope).agg(F.min_by("arm", F.struct("mae", "arm")).alias("best_arm"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    return wide.join(best, list(scope)).withColumn("uneven", F.col("n_max") > 2 * F.col("n_min"))


def diebold_mariano(rows: DataFrame, arm: str, reference: str, scope: Sequence[str] = SCOPE, least: int = 30) -> DataFrame:
    """n, mean loss difference, statistic and two-sided p of ``arm`` against ``reference`` (absolute errors, paired on ts_target).

    Newey-West variance with Bartlett weights over floor(n ** (1/3)) lags, at
    least one; the covariance at lag k is the mean over n - k pairs. Null under
    ``least`` pairs or without variance. Lagged pairs meet by a join on places.
    """
    both = rows.filter(F.col("arm").isin(arm, reference))
    of = lambda a, c: F.when(F.col("arm") == a, c)
    loss = {n: F.max_by(of(a, F.abs("error")), of(a, F.col("ts"))) for n, a in (("_a", arm), ("_b", reference))}
    pairs = both.groupBy(*scope, "ts_target").agg(*[c.alias(n) for n, c in loss.items()]).filter("_a IS NOT NULL AND _b IS NOT NULL").withColumn("d", F.col("_a") - F.col("_b"))
    # Written twice, as places, totals and lagged pairs each read it: the forecasts behind it are made once.
    pairs = materialised(pairs.select(*scope, "ts_target", "d"), "losses")
    placed = materialised(blocks.with_totals(blocks.numbered(pairs, scope, ["ts_target"], name="_i"), scope, _m=F.avg("d"), _n=F.count("*")), "placed")
    placed = placed.select(*scope, "_i", "_n", "_m", (F.col("d") - F.col("_m")).alias("_c"), F.greatest(F.lit(1), F.floor(F.pow(F.col("_n").cast("double"), 1 / 3))).alias("_l"))
    lagged = placed.select(*scope, "_n", "_l", F.explode(F.sequence(F.lit(1), F.col("_l").cast("int"))).alias("_k"), "_i", F.col("_c").alias("_before")).withColumn("_i", F.col("_i") + F.col("_k"))
    products = lagged.join(placed.select(*scope, "_i", "_c"), [*scope, "_i"]).groupBy(*scope, "_k").agg(
        F.sum(2 * (1 - F.col("_k") / (F.col("_l") + 1.0)) * F.col("_before") * F.col("_c") / (F.col("_n") - F.col("_k"))).alias("_g"))
    lags = products.groupBy(*scope).agg(F.sum("_g").alias("_g"))
    base = placed.groupBy(*scope).agg(F.count("*").alias("n"), F.first("_m").alias("mean_difference"), F.avg(F.col("_c") * F.col("_c")).alias("_g0"))
    both = base.join(lags, list(scope), "left").withColumn("_var", F.col("_g0") + F.coalesce("_g", F.lit(0.0)))
    stat = F.when((F.col("n") >= least) & (F.col("_var") > 0), F.try_divide(F.col("mean_difference"), F.sqrt(F.when(F.col("_var") > 0, F.col("_var") / F.col("n")))))
    return both.select(*scope, "n", "mean_difference", stat.alias("statistic"), erfc(F.abs(stat) / F.sqrt(F.lit(2.0))).alias("p_value"))


def calibration_curve(rows: DataFrame, bins: int = 5, by: Sequence[str] = ("signal",)) -> DataFrame:
    """Coverage by quantile bins of interval width (the last bin closed), compared to nine digits; nothing for groups under four rows a bin."""
    widths = rows.filter("lo IS NOT NULL AND hi IS NOT NULL AND actual IS NOT NULL").withColumn("width", F.round(F.col("hi") - F.col("lo"), 9))
    edges = order_stats.quantiles(widths, by, "width", [i / bins for i in range(1, bins)], order_stats.FEW).withColumnsRenamed({"n": "_n", "quantiles": "_edges"}).filter(F.col("_n") >= 4 * bins)
    part = F.aggregate("_edges", F.lit(0), lambda s, e: s + (F.col("width") >= e).cast("int"))
    inside = ((F.col("actual") >= F.col("lo")) & (F.col("actual") <= F.col("hi"))).cast("double")
    return widths.join(edges, list(by)).groupBy(*by, part.alias("bin")).agg(F.count("*").alias("n"), F.avg("width").alias("mean_width"), F.avg(inside).alias("coverage"))


def chronological_split(rows: DataFrame, horizon: float, by: Sequence[str] = ("signal",), shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """Add ``part`` train, validation or test by row order; rows within ``horizon`` of the next part's start are dropped."""
    place, n = F.col("_i"), F.col("_n")
    a, b = F.floor(n * shares[0] + 1e-9), F.floor(n * (shares[0] + shares[1]) + 1e-9)
    placed = blocks.with_totals(blocks.numbered(rows, by, ["ts", "k"], name="_i"), by, _n=F.count("*"))
    parts = placed.withColumn("part", F.when(place < a, "train").when(place < b, "validation").otherwise("test")).drop("_i", "_n")
    start = lambda p: F.min(F.when(F.col("part") == p, F.col("ts")))
    parts = blocks.with_totals(parts, by, _v=start("validation"), _t=start("test"))
    late = ((F.col("part") == "train") & (F.col("ts") >= F.col("_v") - horizon)) | ((F.col("part") == "validation") & (F.col("ts") >= F.col("_t") - horizon))
    return parts.filter(~F.coalesce(late, F.lit(False))).drop("_v", "_t")


def rolling_origin(rows: DataFrame, folds: int, horizon: float, by: Sequence[str] = ("signal",), least_share: float = 0.4) -> DataFrame:
    """(fold, part, n, first, last) of an expanding evaluation: fold f tests the f-th of ``folds`` equal parts after ``least_share`` and trains on all before its embargo."""
    placed = blocks.with_totals(blocks.numbered(rows, by, ["ts", "k"], name="_i"), by, _n=F.count("*"))
    start = F.floor(F.col("_n") * least_share + 1e-9)
    step = F.floor((F.col("_n") - start) / folds)
    exploded = placed.withColumns({"_s": start, "_w": step}).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    first = F.col("_s") + F.col("fold") * F.col("_w")
    test = (F.col("_i") >= first) & (F.col("_i") < first + F.col("_w"))
    marked = blocks.with_totals(exploded.withColumn("_test", test), [*by, "fold"], _open=F.min(F.when(F.col("_test"), F.col("ts"))))
    part = F.when(F.col("_test"), "test").when((F.col("_i") < first) & (F.col("ts") < F.col("_open") - horizon), "train")
    return marked.withColumn("part", part).filter("part IS NOT NULL").groupBy(*by, "fold", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def rolling_quantile(rows: DataFrame, share: float, window: int, least: int, by: Sequence[str] = SCOPE, order: str = "ts_target", block: int = blocks.ROWS) -> DataFrame:
    """Add ``width``: the linear quantile of the last ``window`` absolute errors before each row; null under ``least`` of them."""
    before = lambda keys: F.collect_list("abs_error").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1))
    # Written once: dealing into blocks reads it more than once, and scored forecasts are dear.
    rows = blocks.within(materialised(rows, "errors"), by, order, 0, window, lambda r, keys: r.withColumn("_sorted", F.sort_array(before(keys))), block, ts=order)
    at = (F.size("_sorted") - 1) * share
    low = F.floor(at).cast("int")
    pick = lambda i: F.get("_sorted", i)
    width = pick(low) + (at - low) * (F.coalesce(pick(low + 1), pick(low)) - pick(low))
    return rows.withColumn("width", F.when(F.size("_sorted") >= least, width)).drop("_sorted")


def arm_wins(report: DataFrame, arm: str, against: str, margin: float = 0.01, scope: Sequence[str] = SCOPE) -> DataFrame:
    """One row: scopes in which ``arm`` is better or worse than ``against`` by over ``margin``."""
    pair = report.groupBy(*scope).agg(F.max(F.when(F.col("arm") == arm, F.col("mae"))).alias("a"), F.max(F.when(F.col("arm") == against, F.col("mae"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    gain = 1 - F.try_divide(F.col("a"), F.col("b"))
    return pair.agg(F.count("*").alias("scopes"), F.count_if(gain > margin).alias("better"), F.count_if(gain < -margin).alias("worse"))


def distinct_versions(version: Column | str) -> Column:
    """The versions that a group's forecasts came from, sorted; an aggregate."""
    return F.sort_array(F.collect_set(version))


def clipped_interval(predicted: Column, width: Column, lo: float, hi: float) -> tuple[Column, Column]:
    """(low, high) of an interval, both held within the signal's range; a forecast outside the range lies outside its interval."""
    return clip(predicted - width, lo, hi), clip(predicted + width, lo, hi)
