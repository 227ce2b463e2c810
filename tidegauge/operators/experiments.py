"""Experiments: suites of arms replayed over the same examples, judged on the held-out tail, and refused where they can't be compared."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import blocks
from tidegauge.operators import replay, reports
from tidegauge.session import materialised

#: The suites and their arms.
SUITES: dict[str, tuple[str, ...]] = {
    "core": ("static", "online_periodic", "online_drift", "online_periodic_drift"), "safety": ("online_periodic_drift", "online_no_gate"),
    "design": ("online_periodic_drift", "no_trust_region", "trust_region_correction", "no_baseline_features"), "regime": ("online_periodic_drift", "per_regime"), "full": tuple(replay.ARMS),
}
#: Samples under which a chronological split tells nothing.
LEAST_SAMPLES = 200
REFERENCE = "persistence"


def boundary(ticks: DataFrame, share: float = 0.5, least: int = LEAST_SAMPLES) -> float:
    """The time of the sample that ``share`` of all samples (distinct ``ts``) come before; ValueError with fewer than ``least`` samples."""
    placed = materialised(blocks.numbered(ticks.filter("ts IS NOT NULL").select(F.col("ts").cast("double").alias("ts")).distinct(), (), ["ts"]), "samples")
    n = placed.count()
    if n < least:
        raise ValueError(f"{n} samples are too few for a chronological split, which takes {least}")
    return placed.filter(F.col("_n") == min(int(n * share), n - 1)).first()["ts"]


def check_same_data(outcomes: DataFrame, by: Sequence[str] = ("signal",), digits: int = 9) -> None:
    """AssertionError unless persistence (rows arm, …, abs_error) has the same count and mean error in the replays of all arms, scope by scope.

    It does not depend on an arm, so where it differs the arms saw different data. One row a scope is compared; scopes that an arm does not have differ too.
    """
    each = outcomes.groupBy("arm", *by).agg(F.struct(F.count("*").alias("n"), F.round(F.avg("abs_error"), digits).alias("mae")).alias("seen"))
    arms = outcomes.select("arm").distinct().count()
    odd = each.groupBy(*by).agg(F.count("*").alias("arms"), F.array_sort(F.collect_set("seen")).alias("seen")).filter((F.size("seen") > 1) | (F.col("arms") < arms))
    found = odd.orderBy(*by).limit(5).collect()
    if found:
        raise AssertionError("arms saw different data: " + "; ".join(f"{', '.join(str(r[c]) for c in by)}: {r['arms']} of {arms} arms, {[tuple(s) for s in r['seen']]}" for r in found))


def _slices(windows: int, first: Column, last: Column) -> Column:
    """What each outcome counts for: all, its regime, and one of ``windows`` equal spans of the held-out time."""
    at = F.least(F.floor(F.try_divide((F.col("ts_target") - first) * windows, last + 1e-6 - first)), F.lit(windows - 1))
    part = lambda name, value: F.struct(F.lit(name).alias("part"), value.cast("string").alias("slice"))
    return F.array(part("all", F.lit("*")), part("regime", F.coalesce("regime", F.lit("unknown"))), part("window", at.cast("int")))


def run(
    examples: DataFrame, ticks: DataFrame, x: Sequence[str], baseline_x: Sequence[str] = (), suites: Mapping[str, Sequence[str]] | None = None, share: float = 0.5, windows: int = 4, least: int = LEAST_SAMPLES,
    drifts: DataFrame | None = None, **options) -> DataFrame:
    """(suite, arm, part, slice, signal, n, mae, rmse, bias, …, skill) of the held-out tail, over all, by regime and over time; persistence is an arm of every suite.

    An arm that is in several suites is replayed once. ``examples`` are those of
    ``replay.adaptation``; ``ticks`` (ts) are the samples, whose share ``share``
    comes before the held-out part, the same for all signals. Raises for too
    few samples and where arms saw different data.
    """
    suites = SUITES if suites is None else suites
    unknown = sorted({a for arms in suites.values() for a in arms} - set(replay.ARMS))
    if unknown:
        raise ValueError(f"unknown arms {unknown}; known are {sorted(replay.ARMS)}")
    begins = boundary(ticks, share, least)
    arms = tuple(a for a in replay.ARMS if any(a in s for s in suites.values()))
    # Signals are a registered, small set: one row each.
    bounds = examples.select("signal").distinct().withColumn("boundary", F.lit(begins))
    played = replay.adaptation(examples, x, baseline_x, arms, train_share=share, drifts=drifts, boundary=bounds, **options)
    tail = materialised(played.filter("held_out").select("arm", "signal", "ts_target", "predicted", "actual"), "tail")
    known = examples.select("signal", "ts_target", "anchor", F.col("regime") if "regime" in examples.columns else F.lit(None).cast("string").alias("regime"))
    outcomes = materialised(tail.join(known, ["signal", "ts_target"]), "outcomes")
    check_same_data(outcomes.withColumn("abs_error", F.abs(F.col("anchor") - F.col("actual"))))
    naive = outcomes.filter(F.col("arm") == arms[0]).withColumns({"arm": F.lit(REFERENCE), "predicted": F.col("anchor")})
    both = outcomes.filter("predicted IS NOT NULL").unionByName(naive).withColumn("error", F.col("predicted") - F.col("actual")).withColumn("abs_error", F.abs("error"))
    ends = outcomes.agg(F.min("ts_target").alias("_first"), F.max("ts_target").alias("_last"))
    # One row of ends, known to every task.
    cut = both.join(F.broadcast(ends), F.lit(True)).withColumn("_part", F.explode(_slices(windows, F.col("_first"), F.col("_last")))).select("arm", "signal", "_part.*", "predicted", "actual", "error", "abs_error")
    report = reports.with_skill(reports.metrics(cut, ["arm", "part", "slice", "signal"]), ["part", "slice", "signal"])
    of_arm = {a: [s for s, named in suites.items() if a in named] for a in arms} | {REFERENCE: list(suites)}
    listed = F.create_map(*[c for a, s in of_arm.items() for c in (F.lit(a), F.array(*map(F.lit, s)))])
    return report.withColumn("suite", F.explode(listed[F.col("arm")]))
