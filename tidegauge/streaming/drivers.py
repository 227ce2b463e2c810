"""Structured Streaming drivers: the batch kernels with their state kept by the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.operators import states
from tidegauge.operators.sequential import Cooldown, PageHinkley
from tidegauge.session import ship


def stepped(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], make: Callable[[tuple], Sequence], step: Callable[[Sequence, dict], tuple], schema: str) -> DataFrame:
    """The streaming form of ``operators.replay.stepped``: a key's kernels are its state, stored as text by ``operators.states``.

    Rows of one micro-batch are taken in ``order``; rows that come in a later
    one are taken later, so results equal the batch form's where arrival
    follows ``order``.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kernel = list(states.decode(state.get[0])) if state.exists else list(make(key))
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = [(*key, *(row[c] for c in columns), *step(kernel, row)) for row in frame.to_dict("records")]
        state.update((states.encode(kernel),))
        yield pd.DataFrame(out, columns=names)

    ship(rows.sparkSession)
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "kernel string", "append", GroupStateTimeout.NoTimeout)


def drift(errors: DataFrame, key: str = "signal", order: str = "ts_target", value: str = "abs_error", cooldown: float = 300.0) -> DataFrame:
    """Streaming Page-Hinkley alarms over scored errors, with the cooldown."""

    def step(state: tuple, row: dict) -> tuple:
        alarm, statistic = state[0].step(row[value])
        return statistic, alarm, bool(alarm and state[1].step("error", row[order]))

    return stepped(errors.select(key, order, value), [key], order, [order], lambda _: (PageHinkley(), Cooldown(cooldown)), step, f"{key} string, {order} double, statistic double, alarm boolean, event boolean")


def live_windows(readings: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean, least and greatest value of each signal in tumbling windows; readings later than ``late`` are dropped.

    ``readings`` has a timestamp column ``at``, signal and value.
    """
    grouped = readings.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "signal")
    return grouped.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).select("w.start", "w.end", "signal", "n", "mean", "low", "high")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that is there, append it to Parquet, and read the result."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)
