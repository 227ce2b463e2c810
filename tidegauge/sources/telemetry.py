"""Telemetry datasets as a data source, ``spark.read`` and ``spark.readStream`` with format ``telemetry``.

    register(spark)
    spark.readStream.format("telemetry").load(folder)

A source says which signals it has (``signals``), whether it can be used at all
(``probe``) and gives readings. Rows are those of ``datasets.read``: (ts, origin,
gap_s, collect_ms, signal, value, quality); a value that is not there is null, a
sample without readings one row without a signal, a line that is no sample no
row. A file is a partition, read line by line in a task, so memory is bounded by
a batch. Options ``since``, ``until`` (inclusive) and ``signals`` (comma-joined)
leave rows out while a file is read. They are options, not pushed filters: a
frame keeps its reader, and in this version of Spark what one query pushes into
it stays there for the next query over the same frame.

As a stream, files become rows in the order of their paths; whoever adds files
names them in rising order (by time, as recorders do). The offset is the last
path and how many files there were up to it, so it does not grow, and a file
that came late is an error, not a silent loss. Files may be removed once they
are read. Paths are what pyarrow's file systems take: local, s3://, hdfs://.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidegauge.session import ship

SCHEMA = "ts double, origin string, gap_s double, collect_ms double, signal string, value double, quality int"
#: Rows that a task holds at once.
BATCH = 4_096
#: First and last time, and the signals, that are wanted; no signals are all, samples without readings among them.
Wanted = tuple[float, float, frozenset[str]]
ALL: Wanted = (-math.inf, math.inf, frozenset())


class LateFile(RuntimeError):
    """A file appeared at or before a path that the stream had already passed."""


def _system(path: str) -> tuple[Any, str]:
    """(file system, path in it) of a path or URI; Spark writes local ones as ``file:/x`` too."""
    from pyarrow import fs

    local = not path.startswith("file:") and "://" not in path
    if local or path.startswith("file:"):
        return fs.LocalFileSystem(), path if local else "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _listed(path: str) -> tuple[Any, list[str]]:
    """(file system, data files in the order of their paths) below a folder or of one file; hidden and marker files are left out."""
    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    base = len(root.rstrip("/"))
    shown = lambda p: not any(part[:1] in ("_", ".") for part in p[base:].split("/"))
    return system, sorted(f.path for f in found if f.type == fs.FileType.File and (f.path == root or shown(f.path)))


def _lines(path: str, file: str) -> Iterator[dict]:
    system, _ = _system(path)
    with system.open_input_stream(file, compression="detect") as raw, io.TextIOWrapper(raw, encoding="utf-8", errors="replace") as text:
        for line in text:
            try:
                found = json.loads(line)
            except ValueError:
                continue
            if isinstance(found, dict):
                yield found


def _number(x: Any) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) else None


def _rows(path: str, file: str, kept: Wanted = ALL) -> Iterator[tuple]:
    since, until, signals = kept
    for x in _lines(path, file):
        ts = _number(x.get("ts"))
        if "signals" in x or ts is None or not since <= ts <= until:
            continue
        head = (ts, x.get("origin"), _number(x.get("gap_s")), _number(x.get("collect_ms")))
        readings = x.get("r") if isinstance(x.get("r"), dict) else {}
        for signal, v in (readings or {None: None}).items():
            if signals and signal not in signals:
                continue
            v = v if isinstance(v, list) else []
            quality = _number(v[1]) if len(v) > 1 else None
            yield (*head, signal, _number(v[0]) if v else None, int(quality or 0))


def _batches(path: str, file: str, kept: Wanted = ALL) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("ts", pa.float64()), ("origin", pa.string()), ("gap_s", pa.float64()), ("collect_ms", pa.float64()), ("signal", pa.string()), ("value", pa.float64()), ("quality", pa.int32())])
    held: list[tuple] = []
    cut = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    for row in _rows(path, file, kept):
        held.append(row)
        if len(held) == BATCH:
            yield cut()
            held = []
    if held:
        yield cut()


class File(InputPartition):
    def __init__(self, file: str):
        self.file = file


class TelemetrySource(DataSource):
    """The source contract over dataset files."""

    @classmethod
    def name(cls) -> str:
        return "telemetry"

    def schema(self) -> str:
        return SCHEMA

    @property
    def path(self) -> str:
        return self.options["path"]

    @property
    def wanted(self) -> Wanted:
        of = self.options.get
        return float(of("since", -math.inf)), float(of("until", math.inf)), frozenset(s for s in of("signals", "").split(",") if s)

    def signals(self) -> list[dict]:
        """The signals that the headers declare, the first header of a name counting; small, as a registry is."""
        _, files = _listed(self.path)
        found: dict[str, dict] = {}
        for file in files:
            head = next(_lines(self.path, file), {})
            for spec in head.get("signals") or []:
                found.setdefault(spec["name"], spec)
        return [found[n] for n in sorted(found)]

    def probe(self) -> bool:
        """Whether the folder can be read and declares a signal."""
        try:
            return bool(self.signals())
        except OSError:
            return False

    def reader(self, schema) -> DataSourceReader:
        return TelemetryReader(self.path, self.wanted)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return TelemetryStream(self.path, self.wanted)


class TelemetryReader(DataSourceReader):
    def __init__(self, path: str, wanted: Wanted = ALL):
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[InputPartition]:
        return [File(f) for f in _listed(self.path)[1]]

    def read(self, partition: InputPartition | None) -> Iterator:
        # A folder without files has no partitions; Spark then asks for None.
        return _batches(self.path, partition.file, self.wanted) if partition else iter(())


class TelemetryStream(DataSourceStreamReader):
    def __init__(self, path: str, wanted: Wanted = ALL):
        self.path, self.wanted = path, wanted

    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": "", "files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _listed(self.path)[1]
        return {"last": files[-1], "files": len(files)} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = _listed(self.path)[1]
        passed = sum(f <= start["last"] for f in files)
        if passed > start["files"]:
            raise LateFile(f"{passed - start['files']} files appeared at or before {start['last']}")
        return [File(f) for f in files if start["last"] < f <= end["last"]]

    def read(self, partition: InputPartition) -> Iterator:
        return _batches(self.path, partition.file, self.wanted)

    def commit(self, end: dict) -> None:
        """Offsets are in the checkpoint; nothing is kept here."""


def register(spark: SparkSession) -> None:
    """Make format ``telemetry`` known to the session and its Python workers."""
    ship(spark)
    spark.dataSource.register(TelemetrySource)
