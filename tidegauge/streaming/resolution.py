"""Resolution of forecasts as a stream: event-time timers hold what is open until its outcome is certain.

The rule is that of ``operators.baselines.resolve``. A forecast waits for the
watermark to pass its target and the tolerance after it, so ticks may come in
any order within the watermark's delay; later ones are dropped by the engine. A
forecast that has a tick before its target but none soon after waits on for the
next tick. State is one signal's open forecasts and the ticks that they, or
forecasts yet to come, may still need; a forecast that no tick follows for
``give_up`` seconds is let go unresolved.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.session import ship

EVENTS = "at timestamp, signal string, kind string, id long, ts double, value double, ts_target double"
RESOLVED = "signal string, id long, ts_target double, actual double, resolved_ts double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def decided(target: float, ticks: list[tuple[float, float | None]], tolerance: float, seen_to: float) -> tuple[str, float | None, float | None]:
    """("wait", "lost" or "done", actual, resolved_ts) for a target, of all ticks (ts, value) up to ``seen_to``."""
    if seen_to < target + tolerance:
        return "wait", None, None
    before = [t for t in ticks if target - tolerance <= t[0] < target]
    after = sorted((t for t in ticks if target <= t[0] <= target + tolerance), key=lambda t: (t[0], t[1] is not None, t[1] or 0.0))
    usable = max(((ts, v) for ts, v in before if v is not None), default=None)
    later = next(((ts, v) for ts, v in after if v is not None), None)
    if after:
        first = after[0]
        if first[1] is not None and (usable is None or abs(first[0] - target) <= abs(usable[0] - target)):
            return "done", first[1], first[0]
        if usable is not None:
            return "done", usable[1], first[0]
        return ("done", later[1], later[0]) if later else ("lost", None, None)
    if not before:
        return "lost", None, None
    following = min((ts for ts, _ in ticks if target < ts <= seen_to), default=None)
    if following is None:
        return "wait", None, None
    return ("done", usable[1], following) if usable else ("lost", None, None)


class Resolver(StatefulProcessor):
    """State of one signal: its ticks by time and its open forecasts by id."""

    def __init__(self, tolerance: float, give_up: float):
        self.tolerance, self.give_up = tolerance, give_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getListState("ticks", "ts double, value double")
        self.open = handle.getListState("open", "id long, ts_target double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks, made = [], []
        for frame in rows:
            for kind, id_, ts, value, target in zip(frame["kind"], frame["id"], frame["ts"], frame["value"], frame["ts_target"], strict=True):
                if kind == "forecast":
                    made.append((int(id_), float(target)))
                elif kind == "tick":
                    ticks.append((float(ts), None if value is None or math.isnan(value) else float(value)))
        if ticks:
            self.ticks.appendList(ticks)
            # A forecast may wait for just this tick.
            self._wake(min(ts for ts, _ in ticks))
        if made:
            self.open.appendList(made)
            self._wake(min(target for _, target in made) + self.tolerance)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen_to = timerValues.getCurrentWatermarkInMs() / 1000.0
        ticks, made = (list(state.get()) if state.exists() else [] for state in (self.ticks, self.open))
        times = [ts for ts, _ in ticks]
        out, kept, needed, wake = [], [], seen_to, math.inf
        ticks.sort(key=lambda t: t[0])
        times.sort()
        for id_, target in made:
            # Ticks that matter: those of the tolerance on either side and the next one after the target.
            part = ticks[bisect_left(times, target - self.tolerance) : bisect_right(times, target + self.tolerance) + 1]
            state, actual, resolved_ts = decided(target, part, self.tolerance, seen_to)
            if state == "done":
                out.append((key[0], id_, target, actual, resolved_ts))
            elif state == "wait" and seen_to <= target + self.give_up:
                kept.append((id_, target))
                needed = min(needed, target)
                later = bisect_right(times, max(seen_to, target))
                wake = min(wake, target + self.tolerance if seen_to < target + self.tolerance else times[later] if later < len(times) else math.inf)
        self.open.put(kept) if kept else self.open.clear()
        left = ticks[bisect_left(times, needed - self.tolerance) :]
        self.ticks.put(left) if left else self.ticks.clear()
        if wake < math.inf:
            self._wake(wake)
        if out:
            yield pd.DataFrame(out, columns=["signal", "id", "ts_target", "actual", "resolved_ts"])

    def _wake(self, at: float) -> None:
        # On a grid of the tolerance, so that many forecasts share a timer.
        self.handle.registerTimer(math.ceil(math.ceil(at / self.tolerance) * self.tolerance * 1000.0))

    def close(self) -> None:
        pass


def events(forecasts: DataFrame, ticks: DataFrame) -> DataFrame:
    """Forecasts (signal, id, ts, ts_target) and ticks (signal, ts, value) as one table of events."""
    none = lambda kind: F.lit(None).cast(kind)
    made = forecasts.select(F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")).alias("at"), "signal", F.lit("forecast").alias("kind"), "id", "ts", none("double").alias("value"), "ts_target")
    seen = ticks.select(F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")).alias("at"), "signal", F.lit("tick").alias("kind"), none("long").alias("id"), "ts", "value", none("double").alias("ts_target"))
    return made.unionByName(seen)


def resolve(stream: DataFrame, interval: float, late: str = "1 hour", give_up: float = 7 * 86400.0) -> DataFrame:
    """(signal, id, ts_target, actual, resolved_ts) of each forecast of a stream of ``events`` once its outcome is certain.

    The session's state store must be RocksDB (``with_timers``). A forecast is
    given once; unresolved ones are not given.
    """
    ship(stream.sparkSession)
    return stream.withWatermark("at", late).groupBy("signal").transformWithStateInPandas(Resolver(max(1.5 * interval, 2.0), give_up), RESOLVED, "append", "eventTime")


def with_timers(spark: SparkSession) -> None:
    """Use the state store that timers need, unless the session has another one set."""
    if "RocksDB" not in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
