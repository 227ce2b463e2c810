"""Tables that batches are written to once: folders of data, and a ledger that says which of them count.

A batch has a name. Its tables are written to new folders, then one ledger entry
names them all: readers see a batch whole or not at all. A crash before the
entry leaves folders that nobody reads. A batch that is delivered twice is
written once; with ``replace`` its new rows take the place of the old ones.
Within a table the row of the newest batch stays for each key.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "name string, place long, seq long, folders string, replaces string"


class Ledger:
    """Tables below ``path``; ``keys`` has the key columns of each table. Null keys are keys."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, Sequence[str]]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), {t: list(k) for t, k in keys.items()}
        # So that the folder of entries is there to read; written by whoever is first.
        spark.createDataFrame([], _ENTRY).write.mode("ignore").parquet(f"{self.path}/ledger/entry=none")

    def entries(self) -> list:
        """The entries that count: of each name the newest, without those that a compaction took in."""
        rows = self.spark.read.schema(_ENTRY).parquet(f"{self.path}/ledger/entry=*").collect()
        newest: dict[str, object] = {}
        for row in sorted(rows, key=lambda r: (r.seq, r.folders)):
            newest[row.name] = row
        gone = {(name, seq) for r in rows if r.replaces for name, seq in json.loads(r.replaces)}
        return sorted((r for r in newest.values() if (r.name, r.seq) not in gone), key=lambda r: (r.place, r.seq))

    def known(self, name: str) -> bool:
        rows = self.spark.read.schema(_ENTRY).parquet(f"{self.path}/ledger/entry=*")
        return bool(rows.filter(F.col("name") == name).take(1))

    def commit(self, name: str, tables: Mapping[str, DataFrame], place: int = 0, replace: bool = False) -> bool:
        """Write a batch; false if it is there already. Of rows with one key and one batch the greatest stays. Batches of a greater ``place`` are newer."""
        if not replace and self.known(name):
            return False
        folders = {}
        for table, rows in tables.items():
            folders[table] = f"{self.path}/data/{table}/{uuid4().hex}"
            self._one_a_key(rows, table).write.parquet(folders[table])
        self._enter(name, place, folders, [])
        return True

    def _enter(self, name: str, place: int, folders: Mapping[str, str], replaces: list) -> None:
        entry = [(name, place, time.time_ns(), json.dumps(folders), json.dumps(replaces) if replaces else None)]
        self.spark.createDataFrame(entry, _ENTRY).coalesce(1).write.parquet(f"{self.path}/ledger/entry={uuid4().hex}")

    def _one_a_key(self, rows: DataFrame, table: str, order: Sequence[str] = ()) -> DataFrame:
        columns = [c for c in rows.columns if c not in order]
        whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])
        best = rows.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(self.keys[table])], whole.alias("_row"), F.struct(*order, whole).alias("_by"))
        kept = best.groupBy(*[f"_key{i}" for i in range(len(self.keys[table]))]).agg(F.max_by("_row", "_by").alias("_row"))
        return kept.select([F.col("_row")[c].alias(c) for c in columns])

    def read(self, table: str) -> DataFrame | None:
        """The rows of a table, one a key; None where no batch has it."""
        parts = []
        for n, entry in enumerate(self.entries()):
            folder = json.loads(entry.folders).get(table)
            if folder:
                parts.append(self.spark.read.parquet(folder).withColumn("_batch", F.lit(n)))
        if not parts:
            return None
        if len(parts) == 1:
            return parts[0].drop("_batch")
        return self._one_a_key(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), table, ["_batch"])

    def compact(self) -> None:
        """Write all that counts as one batch, which takes the others' place in one entry. A batch that comes in meanwhile stays beside it."""
        taken = self.entries()
        if len(taken) < 2:
            return
        folders = {}
        for table in self.keys:
            rows = self.read(table)
            if rows is not None:
                folders[table] = f"{self.path}/data/{table}/{uuid4().hex}"
                rows.write.parquet(folders[table])
        self._enter(f"compacted-{uuid4().hex}", max(e.place for e in taken), folders, [[e.name, e.seq] for e in taken])

    def sink(self, query: str, split: Callable[[DataFrame], Mapping[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: each micro-batch of ``query`` is a batch of its own, written once however often it is delivered."""

        def write(rows: DataFrame, batch: int) -> None:
            held = rows.persist()
            try:
                self.commit(f"{query}-{batch}", split(held), batch)
            finally:
                held.unpersist()

        return write
