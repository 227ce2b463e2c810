"""Resolution as a stream against the batch rule; ledger tables under redelivery and crashes."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import baselines
from tidegauge.sources import datasets
from tidegauge.sources.ledger import Ledger
from tidegauge.streaming import resolution


def world(seed):
    """(forecasts, ticks): gaps, missing values, repeated ticks, targets without anything near."""
    r = random.Random(seed)
    ticks, made = [], []
    for signal in ("a", "b"):
        ts = 0.0
        for n in range(160):
            ts += r.choice([5.0, 5.0, 5.0, 6.0, 60.0 if r.random() < 0.2 else 5.0])
            ticks.append((signal, ts, None if r.random() < 0.2 else round(r.gauss(0, 1), 3)))
            if n % 3 == 0:
                made.append((signal, n, ts, ts + r.choice([15.0, 17.3, 40.0])))
    return made, ticks


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stream_equals_batch_under_shuffled_arrival(spark, tmp_path, seed):
    made, ticks = world(seed)
    forecasts = spark.createDataFrame(made, "signal string, id long, ts double, ts_target double")
    seen = spark.createDataFrame(ticks, "signal string, ts double, value double")
    want = sorted((r.signal, r.id, r.actual, r.resolved_ts) for r in baselines.resolve(forecasts, seen, 5.0).filter("resolved_ts IS NOT NULL").collect())
    rows = resolution.events(forecasts, seen).collect()
    rows.sort(key=lambda x: x.ts + random.Random(f"{seed}{x}").uniform(0, 90))  # within the watermark's two minutes
    resolution.with_timers(spark)
    schema, got = resolution.events(forecasts, seen).schema, []
    for n in range(4):
        part = rows[n * len(rows) // 4 : (n + 1) * len(rows) // 4]
        if n == 3:
            last = max(x.at for x in rows)
            part = part + [(last.replace(year=last.year + 1), "", "clock", None, 0.0, None, None)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = resolution.resolve(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5.0, "2 minutes", 10**9)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.signal, r.id, r.actual, r.resolved_ts) for r in spark.read.schema(resolution.RESOLVED).parquet(str(tmp_path / "out")).collect())
    assert got == want and len(want) > 50


def test_decisions():
    ticks = [(10.0, 1.0), (20.0, None), (22.0, 3.0), (90.0, 5.0)]
    assert resolution.decided(21.0, ticks, 8.0, 28.0)[0] == "wait"
    assert resolution.decided(21.0, ticks, 8.0, 29.0) == ("done", 3.0, 22.0)
    assert resolution.decided(15.0, ticks, 8.0, 100.0) == ("done", 1.0, 20.0)
    assert resolution.decided(30.0, ticks, 8.0, 50.0) == ("wait", None, None) and resolution.decided(30.0, ticks, 8.0, 95.0) == ("done", 3.0, 90.0)
    assert resolution.decided(60.0, ticks, 8.0, 200.0)[0] == "lost"


KEYS = {"samples": ("sample_id",), "readings": ("sample_id", "signal")}


def frames(spark, first, value):
    samples = spark.createDataFrame([(i, float(i)) for i in range(first, first + 5)] * 2, "sample_id long, ts double")
    readings = spark.createDataFrame([(i, s, value) for i in range(first, first + 5) for s in "ab"], "sample_id long, signal string, value double")
    return {"samples": samples, "readings": readings}


def rows(ledger, table):
    return sorted(map(tuple, ledger.read(table).collect()))


def test_a_batch_delivered_twice_counts_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "t"), KEYS)
    assert ledger.read("samples") is None
    assert ledger.commit("one", frames(spark, 0, 1.0)) and not ledger.commit("one", frames(spark, 0, 9.0))
    assert rows(ledger, "samples") == [(i, float(i)) for i in range(5)] and {r[2] for r in rows(ledger, "readings")} == {1.0}
    # A later batch takes the place of rows with the same keys, whatever the order in which both arrived.
    Ledger(spark, str(tmp_path / "t"), KEYS).commit("three", frames(spark, 3, 3.0), place=3)
    ledger.commit("two", frames(spark, 3, 2.0), place=2)
    assert len(rows(ledger, "samples")) == 8 and {r[2] for r in rows(ledger, "readings") if r[0] >= 3} == {3.0}
    before = rows(ledger, "readings")
    ledger.compact()
    assert rows(ledger, "readings") == before and len(ledger.entries()) == 1 and not ledger.commit("two", frames(spark, 3, 7.0), place=2)
    assert ledger.commit("one", frames(spark, 0, 4.0), place=4, replace=True)
    assert {r[2] for r in rows(ledger, "readings") if r[0] < 5} == {4.0}


def test_a_crash_between_the_two_writes_leaves_nothing(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "t"), KEYS)
    ledger.commit("one", frames(spark, 0, 1.0))
    broken = frames(spark, 20, 2.0)
    broken["readings"] = broken["readings"].withColumn("value", F.raise_error(F.lit("disk gone")).cast("double"))
    with pytest.raises(Exception, match="disk gone"):
        ledger.commit("two", broken)
    assert len(rows(ledger, "samples")) == 5
    assert ledger.commit("two", frames(spark, 20, 2.0)) and len(rows(ledger, "samples")) == 10
    monkeypatch.setattr(Ledger, "_enter", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        ledger.commit("three", frames(spark, 40, 3.0))
    monkeypatch.undo()
    assert len(rows(ledger, "samples")) == 10 and ledger.commit("three", frames(spark, 40, 3.0)) and len(rows(ledger, "readings")) == 30


def test_a_stream_that_repeats_its_batches(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "t"), {"x": ("id",)})
    spark.range(50).withColumn("v", F.lit(1)).repartition(5).write.parquet(str(tmp_path / "in"))
    for check in ("a", "b"):  # the second checkpoint knows nothing of the first: all batches come again
        stream = spark.readStream.schema("id long, v int").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(ledger.sink("q", lambda b: {"x": b})).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
    assert ledger.read("x").count() == 50 and len(ledger.entries()) == 3


def test_loading_a_run_twice_stores_it_once(spark, tmp_path):
    samples = spark.createDataFrame([(float(n), "live", 5.0, 1.0, {"cpu": (float(n), 0)}) for n in range(6)], "ts double, origin string, gap_s double, collect_ms double, readings map<string,struct<value:double,quality:int>>")
    signals = spark.createDataFrame([("cpu",)], "name string")
    datasets.write(samples, signals, str(tmp_path / "d"))
    for run in ("r1", "r1", "r2"):
        datasets.load(spark, str(tmp_path / "d"), run, str(tmp_path / "s"))
    assert datasets.stored(spark, str(tmp_path / "s"), "r1").count() == 6 and datasets.stored(spark, str(tmp_path / "s")).count() == 12
