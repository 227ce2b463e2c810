"""The telemetry data source: what the dataset reader gives, pushed conditions, and a stream that restarts without loss or repetition."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import datasets, telemetry

HEAD = {"format": 1, "notes": "", "signals": [{"name": "a", "kind": "gauge"}, {"name": "b", "kind": "rate"}]}


def line(ts, **r):
    return json.dumps({"ts": ts, "origin": "live", "gap_s": None, "collect_ms": 1.5, "r": r})


def put(folder, name, lines, packed=False):
    folder.mkdir(exist_ok=True)
    data = "".join(x + "\n" for x in lines).encode()
    (folder / name).write_bytes(gzip.compress(data) if packed else data)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def folder(tmp_path, spark):
    telemetry.register(spark)
    at = tmp_path / "data"
    put(at, "000.jsonl", [json.dumps(HEAD), line(1.0, a=[5.0], b=[None, 5]), line(2.0, a=[7.5, 2]), line(3.0), "no sample", "[1]", line(None, a=[1.0]), ""])
    put(at, "001.jsonl.gz", [line(4.0, a=[8.0], b=[0.0, 1])], packed=True)
    put(at, "_SUCCESS", [])
    return at


def test_rows_are_those_of_the_dataset_reader(spark, folder):
    got = spark.read.format("telemetry").load(str(folder))
    want, signals = datasets.read(spark, str(folder))
    assert rows(got.select(want.columns)) == rows(want) and got.count() == 6
    source = telemetry.TelemetrySource({"path": str(folder)})
    assert source.probe() and [s["name"] for s in source.signals()] == ["a", "b"] == sorted(r.name for r in signals.collect())
    assert not telemetry.TelemetrySource({"path": str(folder / "none")}).probe()
    for uri in (f"file:{folder}", f"file://{folder}"):
        assert spark.read.format("telemetry").load(uri).count() == 6


def test_options_leave_rows_out(spark, folder):
    read = lambda **options: spark.read.format("telemetry").options(**options).load(str(folder))
    whole = spark.createDataFrame(read().collect(), read().schema)
    for options, condition in (({"since": "2"}, "ts >= 2"), ({"since": "2", "until": "3.5"}, "ts BETWEEN 2 AND 3.5"), ({"signals": "a"}, "signal = 'a'"), ({"signals": "b,c", "until": "1"}, "signal IN ('b', 'c') AND ts <= 1")):
        assert rows(read(**options)) == rows(whole.filter(condition)), condition
    df = read()
    assert df.filter("ts > 3").count() == 2 and df.count() == 6


def test_a_stream_restarts_where_it_stopped(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("telemetry").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        stream.trigger(availableNow=True).start().awaitTermination(120)
        return rows(spark.read.parquet(str(tmp_path / "out")))

    whole = lambda: rows(spark.read.format("telemetry").load(str(folder)))
    assert run() == whole()
    put(folder, "002.jsonl", [line(5.0, a=[1.0]), line(6.0, b=[2.0])])
    assert run() == whole() and len(run()) == 8
    # What has been read may go; new files still follow.
    read = whole()
    (folder / "001.jsonl.gz").unlink()
    put(folder, "003.jsonl", [line(7.0, a=[3.0])])
    assert len(run()) == len(read) + 1


def test_late_files_are_an_error(folder):
    stream = telemetry.TelemetryStream(str(folder))
    start = stream.latestOffset()
    put(folder, "0005.jsonl", [line(9.0, a=[1.0])])
    with pytest.raises(telemetry.LateFile):
        stream.partitions(start, stream.latestOffset())


def test_batches_are_bounded(folder, monkeypatch):
    monkeypatch.setattr(telemetry, "BATCH", 2)
    assert [b.num_rows for b in telemetry._batches(str(folder), str(folder / "000.jsonl"))] == [2, 2]


def test_empty_folder(spark, folder, tmp_path):
    (tmp_path / "empty").mkdir()
    assert spark.read.format("telemetry").load(str(tmp_path / "empty")).select(F.count("*")).first()[0] == 0
    assert telemetry.TelemetryStream(str(tmp_path / "empty")).latestOffset() == {"last": "", "files": 0}
