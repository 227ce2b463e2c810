"""Datasets of newline-delimited JSON: a header line with the signals, then one line a sample.

A sample is ``{"ts", "origin", "gap_s", "collect_ms", "r": {signal: [value] or
[value, quality]}}``; a lone value has quality 0.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.ledger import Ledger

FORMAT = 1
SAMPLE = "ts double, origin string, gap_s double, collect_ms double, r map<string,array<double>>"
SPEC = "array<struct<name:string,unit:string,kind:string,lo:double,hi:double,max_rate_per_s:double,max_hold_s:double,description:string>>"


def write(samples: DataFrame, signals: DataFrame, path: str, notes: str = "") -> None:
    """Write samples (ts, origin, gap_s, collect_ms, readings map<string,struct<value,quality>>) below ``path``.

    The header is a file of its own, ``header``, since parts are written in
    parallel; the signals are a small dimension.
    """
    spark = samples.sparkSession
    head = {"format": FORMAT, "notes": notes, "signals": [{k: v for k, v in r.asDict().items() if v is not None} for r in signals.collect()]}
    spark.range(1).select(F.lit(json.dumps(head)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/header")
    short = F.transform_values("readings", lambda _, r: F.when((r["quality"] == 0) & r["value"].isNotNull(), F.array(r["value"])).otherwise(F.array(r["value"], r["quality"].cast("double"))))
    rows = samples.select(F.to_json(F.struct("ts", "origin", "gap_s", "collect_ms", short.alias("r")), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.mode("overwrite").text(f"{path}/rows", compression="gzip")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, signals) of a dataset folder or of one file whose first line is the header.

    Readings come in long form: (ts, origin, gap_s, collect_ms, signal, value, quality).
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    header = F.get_json_object("value", "$.signals").isNotNull()
    signals = lines.filter(header).select(F.explode(F.from_json(F.get_json_object("value", "$.signals"), SPEC)).alias("s")).select("s.*")
    rows = lines.filter(~header).select(F.from_json("value", SAMPLE).alias("x")).select("x.*").filter("ts IS NOT NULL")
    pairs = rows.select("ts", "origin", "gap_s", "collect_ms", F.explode_outer("r").alias("signal", "v"))
    value, quality = F.get("v", F.lit(0)), F.coalesce(F.get("v", F.lit(1)), F.lit(0.0)).cast("int")
    return pairs.select("ts", "origin", "gap_s", "collect_ms", "signal", value.alias("value"), quality.alias("quality")), signals


def export(samples: DataFrame, readings: DataFrame, signals: DataFrame, path: str, run: str | None = None, since: float | None = None, until: float | None = None, key: str = "sample_id") -> None:
    """Write stored telemetry as a dataset, in the order of time.

    ``samples`` has ``key``, run, ts, origin, gap_s and collect_ms, ``readings``
    ``key``, signal, value and quality; of repeated readings the greatest stays.
    """
    part = samples if run is None else samples.filter(F.col("run") == run)
    part = part if since is None else part.filter(F.col("ts") >= since)
    part = part if until is None else part.filter(F.col("ts") <= until)
    # A sample has one entry a registered signal, so its map is small.
    single = readings.filter("signal IS NOT NULL").groupBy(key, "signal").agg(F.max(F.struct("value", F.col("quality").cast("int").alias("quality"))).alias("_r"))
    maps = single.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("signal", "_r"))).alias("readings"))
    whole = part.join(maps, key, "left").withColumn("readings", F.coalesce("readings", F.expr("CAST(map() AS map<string,struct<value:double,quality:int>>)")))
    write(whole.orderBy("ts", key), signals, path, notes=f"export run={run}")


#: Tables of stored telemetry and their keys.
STORED = {"samples": ("sample_id",), "readings": ("sample_id", "signal")}


def load(spark: SparkSession, path: str, run: str, into: str) -> None:
    """Store a dataset's samples and readings under the name of a run. Loading a run again replaces it: its rows are there once."""
    rows, _ = read(spark, path)
    named = rows.withColumn("run", F.lit(run)).withColumn("sample_id", F.xxhash64("run", "ts", F.coalesce("origin", F.lit(""))))
    samples = named.select("sample_id", "run", "ts", "origin", "gap_s", "collect_ms")
    readings = named.filter("signal IS NOT NULL").select("sample_id", "run", "ts", "signal", "value", "quality")
    Ledger(spark, into, STORED).commit(f"run {run}", {"samples": samples, "readings": readings}, replace=True)


def stored(spark: SparkSession, into: str, run: str | None = None) -> DataFrame:
    """(ts, origin, gap_s, collect_ms, signal, value, quality) of what ``load`` has stored, as ``read`` gives them; samples without readings stay."""
    ledger = Ledger(spark, into, STORED)
    samples, readings = ledger.read("samples"), ledger.read("readings").select("sample_id", "signal", "value", "quality")
    part = samples if run is None else samples.filter(F.col("run") == run)
    return part.join(readings, "sample_id", "left").select("ts", "origin", "gap_s", "collect_ms", "signal", "value", "quality")


def save_report(report: DataFrame, runs: str, run: str) -> None:
    """Write a report as JSON below ``runs``/``run`` and ``runs``/latest."""
    for name in (run, "latest"):
        report.write.mode("overwrite").json(f"{runs}/{name}")
