"""Sources of signals: their merged registry, and which readings a failing or slow source gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.replay import stepped

#: Consecutive failures before a source is left alone, and for how many seconds each time.
FAILURES = 3
BACKOFF = (5.0, 15.0, 60.0, 300.0)


def merged(specs: DataFrame, order: str = "place", signal: str = "signal", fields: Sequence[str] = ("unit", "lo", "hi")) -> DataFrame:
    """(signal, source, fields, conflicts): one spec a signal, that of the first available source; ``conflicts`` counts later ones that differ.

    ``specs`` has source, ``order``, available, signal and the fields; sources that are not available are skipped.
    """
    w = Window.partitionBy(signal).orderBy(order)
    same = F.struct(*fields)
    placed = specs.filter("available").withColumns({"_first": F.first(same).over(w), "_n": F.row_number().over(w)})
    kept = placed.groupBy(signal).agg(F.min_by(F.struct("source", *fields), "_n").alias("_s"), F.count_if(~same.eqNullSafe(F.col("_first"))).alias("conflicts"))
    return kept.select(signal, "_s.*", "conflicts")


class Quarantine:
    """What becomes of one source's ticks: read, failed, quarantined, or reused between its own, slower readings."""

    def __init__(self, interval: float = 0.0):
        self.interval = interval
        self.failures = 0
        self.until, self.sampled, self.value = 0.0, 0.0, None

    def step(self, now: float, ok: bool, value: float | None) -> tuple[str, float | None]:
        if self.until > now:
            return "quarantined", None
        if self.interval > 0 and now - self.sampled < self.interval:
            return "reused", self.value
        if not ok:
            self.failures += 1
            if self.failures >= FAILURES:
                self.until = now + BACKOFF[min(self.failures - FAILURES, len(BACKOFF) - 1)]
            return "failed", None
        self.failures, self.until, self.sampled = 0, 0.0, now
        self.value = self.value if value is None else value
        return "read", value


def read_all(attempts: DataFrame, interval: float = 0.0, key: str = "source", order: str = "ts", tie: str = "seq") -> DataFrame:
    """(source, ts, seq, state, value) of every tick of every source.

    ``attempts`` has source, ts, seq, ok (whether a read would succeed) and
    value (null: unavailable). A quarantined source gives null; one with an
    ``interval`` gives its last value in between. State is per source.
    """
    rows = attempts.select(key, order, tie, "ok", "value")
    return stepped(rows, [key], [order, tie], [order, tie], lambda _: Quarantine(interval), lambda state, row: state.step(row[order], row["ok"], row["value"]),
                   f"{key} string, {order} double, {tie} long, state string, value double")
