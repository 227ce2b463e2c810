"""Scans and logs: append-only tables, latest-state views, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import blocks


def latest_by(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: what an upsert would have left."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def newest(rows: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The ``n`` newest rows; ties by the later columns of ``order``."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def samples_with_readings(samples: DataFrame, readings: DataFrame, key: str, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` samples with their readings; the limit is taken before the join, so a sample is never cut."""
    return samples.orderBy(*order).limit(n).join(readings, key, "left")


def pivot_window(rows: DataFrame, signals: Sequence[str], at: Sequence[str] = ("k",), quality: str | None = None) -> DataFrame:
    """Ticks by signals. The signals are named, so unknown ones give null columns and no extra job lists them."""
    value = F.when(F.col(quality) <= 2, F.col("value")) if quality else F.col("value")
    return rows.filter(F.col("signal").isin(list(signals))).groupBy(*at).pivot("signal", list(signals)).agg(F.max(value))


def due(predictions: DataFrame, now: float, limit: int = 5_000) -> DataFrame:
    """Unresolved predictions whose target has come, the oldest first."""
    return predictions.filter(~F.col("resolved") & (F.col("ts_target") <= now)).orderBy("ts_target", "id").limit(limit)


def next_version(registrations: DataFrame, key: Sequence[str] = ("kind", "scope")) -> DataFrame:
    """The next version number of each key, from the registration log, so that pruned versions count."""
    return registrations.groupBy(*key).agg((F.max("version_n") + 1).alias("next_n"))


def active(activations: DataFrame, key: Sequence[str] = ("kind", "scope")) -> DataFrame:
    """The active version of each key: that of its latest activation."""
    return activations.groupBy(*key).agg(F.max_by("version_n", "seq").alias("active_n"))


def pruned(versions: DataFrame, activations: DataFrame, keep: int, key: Sequence[str] = ("kind", "scope")) -> DataFrame:
    """Versions to drop: inactive ones beyond the ``keep`` newest, never the active one or its parent."""
    current = active(activations, key)
    marked = versions.join(current, list(key), "left")
    guarded = marked.filter(F.col("version_n") == F.col("active_n")).select(*key, F.explode(F.array("version_n", "parent_n")).alias("version_n")).filter("version_n IS NOT NULL")
    w = Window.partitionBy(*key).orderBy(F.desc("created_ts"), F.desc("version_n"))
    inactive = marked.filter("active_n IS NULL OR version_n <> active_n").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > keep)
    return inactive.join(guarded, [*key, "version_n"], "left_anti").select(*key, "version_n")


def rollback_target(versions: DataFrame, activations: DataFrame, key: Sequence[str] = ("kind", "scope")) -> DataFrame:
    """Where a rollback goes: the active version's recorded parent, else the newest older version."""
    current = active(activations, key)
    mine = versions.join(current, list(key)).filter(F.col("version_n") == F.col("active_n")).select(*key, "active_n", "parent_n")
    known = versions.select(*key, F.col("version_n").alias("_v"))
    joined = mine.join(known, list(key), "left")
    return joined.groupBy(*key, "active_n").agg(
        F.coalesce(F.max(F.when(F.col("_v") == F.col("parent_n"), F.col("_v"))), F.max(F.when(F.col("_v") < F.col("active_n"), F.col("_v")))).alias("target_n"))


def decimated(rows: DataFrame, most: int, by: Sequence[str] = ("signal",), order: Sequence[str] = ("ts",), span: float = blocks.SPAN) -> DataFrame:
    """Every ceil(n / most)-th row of each key in the order given; values are never averaged. Rows are numbered in blocks of ``span`` of the first order column."""
    total = rows.groupBy(*by).agg(F.count("*").alias("_total"))
    placed = blocks.numbered(rows, by, order, span, "_i")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    sized = placed.join(total.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_total"), same) if by else placed.crossJoin(total)
    return sized.filter(F.col("_i") % F.ceil(F.col("_total") / most) == 0).drop("_i", "_total", *[f"_of_{c}" for c in by])


def retained(rows: DataFrame, cutoff: float) -> DataFrame:
    """Rows that retention keeps."""
    return rows.filter(F.col("ts") >= cutoff)


def retained_with(samples: DataFrame, readings: DataFrame, windows: DataFrame, cutoff: float, key: str = "sample_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(samples, readings, feature windows, one row with ``removed``) after retention: readings go with their sample, predictions are not touched."""
    kept = retained(samples, cutoff)
    return kept, readings.join(kept.select(key), key, "left_semi"), retained(windows, cutoff), samples.agg(F.count_if(F.col("ts") < cutoff).alias("removed"))


def series(rows: DataFrame, signals: Sequence[str], now: float, seconds: float, most: int, at: Sequence[str] = ("k", "ts")) -> DataFrame:
    """Ticks by signals over [now - seconds, now + 1], every ceil(n / most)-th of them; unusable values are null. The first column of ``at`` is numeric."""
    part = rows.filter(F.col("ts").between(now - seconds, now + 1))
    return decimated(pivot_window(part, signals, at), most, (), at)


def top_features(rows: DataFrame, names: Sequence[str], top: int = 15, vector: str = "vec") -> DataFrame:
    """Add ``features``: the ``top`` entries (name, value) of each vector by size, the earlier of equal ones first."""
    entries = F.array_sort(F.transform(vector, lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("place"), x.alias("value"))))
    named = F.array(*map(F.lit, names))
    return rows.withColumn("features", F.transform(F.slice(entries, 1, top), lambda e: F.struct(F.get(named, e["place"]).alias("name"), e["value"].alias("value"))))


def by_id(rows: DataFrame, ids: Sequence[int], key: str = "id") -> DataFrame:
    """The rows of some ids; the filter reaches the scan."""
    return rows.filter(F.col(key).isin(list(ids)))


def listed(rows: DataFrame, order: Sequence[Column], limit: int, since: tuple[str, float] | None = None, **equal) -> DataFrame:
    """The first ``limit`` rows by ``order`` of those that have the given values; a value of None asks nothing. ``since`` is (column, least)."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if since is not None:
        rows = rows.filter(F.col(since[0]) >= since[1])
    return rows.orderBy(*order).limit(limit)


def with_log(rows: DataFrame, log: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with the ``columns`` of the newest entry of an append-only log: resolutions, ends of runs, consumption. Rows without one have nulls."""
    newest = log.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_log"))
    return rows.join(newest, key, "left").select(*[c for c in rows.columns if c not in columns], *[F.col("_log")[c].alias(c) for c in columns])


def reference_now(rows: DataFrame, clock: float, by: Sequence[str] = (), stale: float = 300.0) -> DataFrame:
    """(by, now, live): the clock while readings come in or where there are none, the newest reading once it is over ``stale`` seconds old."""
    newest = rows.groupBy(*by).agg(F.max("ts").alias("_newest"))
    live = F.coalesce(F.lit(float(clock)) - F.col("_newest") <= stale, F.lit(True))
    return newest.select(*by, F.when(live, F.lit(float(clock))).otherwise(F.col("_newest")).alias("now"), live.alias("live"))
