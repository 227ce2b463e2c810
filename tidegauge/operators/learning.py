"""Set-parallel parts of learning: standardising, Gram matrices, gates, frozen scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import blocks
from tidegauge.functions.exprs import clip
from tidegauge.session import materialised


def warmed_up(rows: DataFrame, columns: Sequence[str], first: int, by: Sequence[str] = ("signal",), order: str = "k", floor: float = 0.02, limit: float = 5.0) -> DataFrame:
    """Replace columns by z values against the mean and population deviation of the first ``first`` rows, held within ``limit``."""
    placed = blocks.numbered(materialised(rows, "inputs"), by, [order], name="_i")
    early = lambda c: F.when(F.col("_i") < first, F.col(c))
    sums = {f"_mean_{c}": F.avg(early(c)) for c in columns} | {f"_std_{c}": F.stddev_pop(early(c)) for c in columns}
    known = blocks.with_totals(placed, by, **sums)
    z = {c: clip((F.col(c) - F.col(f"_mean_{c}")) / F.greatest(F.col(f"_std_{c}"), F.lit(floor)), -limit, limit) for c in columns}
    return known.withColumns(z).drop("_i", *sums)


def target(actual: Column, anchor: Column, volatility: Column, limit: float = 8.0) -> Column:
    """What the model learns: the move from the anchor in volatilities."""
    return clip((actual - anchor) / F.greatest(volatility, F.lit(1e-9)), -limit, limit)


def from_target(y: Column, anchor: Column, volatility: Column, lo: float, hi: float) -> Column:
    return clip(anchor + y * F.greatest(volatility, F.lit(1e-9)), lo, hi)


def gram(rows: DataFrame, x: Sequence[str], y: str, by: Sequence[str] = ("signal",)) -> DataFrame:
    """(by, i, j, value) of X'X, with j = len(x) for X'y: one partial aggregate, whatever the number of rows."""
    names = [*x, y]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(names))]
    sums = rows.groupBy(*by).agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g_{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g_{i}_{j}").alias("value")) for i, j in pairs])
    return sums.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def gate_split(rows: DataFrame, gate: int, by: Sequence[str] = ("signal",), order: Sequence[str] = ("ts_target", "k"), recent: int = 600) -> DataFrame:
    """Add ``part`` to the ``recent`` newest rows: the ``gate`` newest are gate, the older train; no gate unless there are more."""
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    kept = rows.withColumn("_i", F.row_number().over(newest)).filter(F.col("_i") <= recent)
    n = F.count("*").over(Window.partitionBy(*by))
    return kept.withColumn("part", F.when((n > gate) & (F.col("_i") <= gate), "gate").otherwise("train")).drop("_i")


def baseline_floor(rows: DataFrame, arms: Sequence[str], by: Sequence[str] = ("signal",)) -> DataFrame:
    """The best baseline's name and mean absolute error over the rows."""
    pairs = rows.select(*by, "actual", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("p")) for a in arms])).alias("b"))
    maes = pairs.filter("b.p IS NOT NULL AND actual IS NOT NULL").groupBy(*by, F.col("b.arm").alias("arm")).agg(F.avg(F.abs(F.col("b.p") - F.col("actual"))).alias("mae"))
    return maes.groupBy(*by).agg(F.min_by("arm", F.struct("mae", "arm")).alias("best_baseline"), F.min("mae").alias("floor_mae"))


def gate_decision(candidate: Column, live: Column, hard: float = 1.15, tolerance: float = 1.0) -> Column:
    """Promote or reject a candidate by its gate error against the live model's."""
    return (
        F.when(candidate.isNull(), "candidate_unscorable").when(live.isNull(), "no_active_model").when(candidate > live * hard, "hard_reject_worse")
        .when(candidate <= live * tolerance, "within_tolerance").otherwise("worse_than_tolerance"))


def linear_score(x: Column, weights: Column) -> Column:
    """Dot product of two arrays, for scoring a frozen model."""
    return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def top_coefficients(models: DataFrame, k: int, by: Sequence[str] = ("signal",)) -> DataFrame:
    """The ``k`` coefficients of greatest size of each model (names and weights are arrays)."""
    rows = models.select(*by, F.posexplode(F.arrays_zip("names", "weights")).alias("place", "c")).select(*by, "place", F.col("c.names").alias("name"), F.col("c.weights").alias("weight"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("weight")), "place")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("place")


POLICIES = ("drift", "periodic_samples", "periodic_time", "error")


def trigger(drifted: Column, fresh: Column, last: Column, now: Column, errors: Column, policies: Sequence[str] = POLICIES, every: int = 240, seconds: float = 3600.0, budget: float = 50.0) -> Column:
    """The first of ``policies`` that calls for an adaptation; null for none.

    An alarm is pending; ``fresh`` outcomes reach ``every``; ``seconds`` have
    passed since the ``last`` adaptation (or there was none) and something is
    fresh; the summed ``errors`` reach the ``budget``.
    """
    when = {
        "drift": drifted, "periodic_samples": fresh >= every, "periodic_time": (last.isNull() | (now - last >= seconds)) & (fresh > 0), "error": errors >= budget,
    }
    chosen = [F.when(F.coalesce(when[p], F.lit(False)), F.lit(p)) for p in POLICIES if p in policies]
    return F.coalesce(*chosen) if chosen else F.lit(None).cast("string")


def routed(events: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, feature) for each scope that a drift event reaches.

    ``events`` has signal, horizon and feature (``signal|family``): an alarm of
    errors reaches its own scope, one of a signal's feature that signal's
    scopes, one of a feature of no signal all scopes.
    """
    head = F.element_at(F.split("feature", r"\|"), 1)
    shared = F.col("feature").isNull() | ~F.col("feature").contains("|") | head.isin("time", "regime", "meta")
    scoped = scopes.select(F.col("signal").alias("_s"), F.col("horizon").alias("_h"))
    named = events.filter("signal IS NOT NULL AND horizon IS NOT NULL").join(scoped, (F.col("signal") == F.col("_s")) & (F.col("horizon") == F.col("_h")))
    others = events.filter("signal IS NULL OR horizon IS NULL").withColumns({"_head": head, "_all": shared})
    own = others.filter("NOT _all").join(scoped, F.col("_head") == F.col("_s"))
    every = others.filter("_all").crossJoin(scoped)
    pick = lambda df: df.select(F.col("_s").alias("signal"), F.col("_h").alias("horizon"), "feature")
    return pick(named).unionByName(pick(own)).unionByName(pick(every))
