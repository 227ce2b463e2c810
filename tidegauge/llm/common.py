"""Helpers shared by the training-data operators.

Tables that must outlive a stage are written below the folder named in
``spark.checkpoint.dir``, which every executor can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.session import materialised as materialise
from tidegauge.session import shared_dir, ship

#: Rows of text handed to a Python worker's inner loop at once; bounds its lists.
SLICE_ROWS = 512


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder, for small tables of iterative operators."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: Column | str = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def ref(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: Iterable[str]) -> Column:
    """Columns as one struct, so that an operator's own names cannot meet theirs."""
    return F.struct(*[ref(n).alias(n) for n in names] or [F.lit(1).alias("none")])


def unpacked(names: Iterable[str], row: str = "row") -> list[Column]:
    """The columns of a packed row."""
    return [F.col(row)[n].alias(n) for n in names]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package at hand on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
