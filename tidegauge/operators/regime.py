"""Operating regimes: an ordered rule list and recent shares; ``scan.settled`` has the hysteresis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import blocks

#: The rules' limits.
LOW_BATTERY, BUILD_SHARE, GPU_ACTIVE, DISK_BUSY, HEAVY, IDLE, INTERACTIVE = 25.0, 0.30, 25.0, 40.0, 65.0, 8.0, 35.0
#: The labels in their order; the first stands for whatever is not among them.
LABELS = ("unknown", "idle", "interactive", "compute_heavy", "gpu_heavy", "io_heavy", "build", "battery_constrained", "charging")
HISTORY = 256


def raw_label(cpu: Column, battery: Column, plugged: Column, charging: Column, build: Column, top1: Column, gpu: Column, disk: Column) -> Column:
    """The label of one tick's values; the first rule that holds wins."""
    builds = (cpu > INTERACTIVE) & ((F.try_divide(build, F.greatest(cpu, F.lit(1e-6))) >= BUILD_SHARE) | ((build >= top1 * 0.8) & (build > INTERACTIVE)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(cpu.isNull(), "unknown").when(yes(charging > 0.5), "charging").when(yes((plugged < 0.5) & (battery <= LOW_BATTERY)), "battery_constrained")
        .when(yes(builds), "build").when(yes((gpu >= GPU_ACTIVE) & (gpu > cpu)), "gpu_heavy").when(yes((disk >= DISK_BUSY) & (cpu < HEAVY)), "io_heavy")
        .when(cpu >= HEAVY, "compute_heavy").when(cpu <= IDLE, "idle").otherwise("interactive"))


def shares(rows: DataFrame, labels: Sequence[str], keys: Sequence[str] = (), order: str = "k", regime: str = "regime", history: int = HISTORY, span: float = blocks.SPAN, block: int = blocks.ROWS) -> DataFrame:
    """Add ``share_<label>``: the label's share of the last ``history`` ticks. Blocks of ``block`` ticks get the ticks before them, so one long run is many tasks."""
    dealt = blocks.looking_back(blocks.numbered(rows, keys, [order], span), history - 1, block)
    w = Window.partitionBy(*keys, blocks.BLOCK).orderBy("_n").rowsBetween(1 - history, 0)
    found = dealt.withColumns({f"share_{x}": F.sum((F.col(regime) == x).cast("double")).over(w) / F.count("*").over(w) for x in labels})
    return found.filter("_own").drop("_own", "_n", blocks.BLOCK)


def one_hot(label: Column | str, labels: Sequence[str] = LABELS) -> list[Column]:
    """``regime_<label>``: 1.0 for the label of the row, the first label for a null or another one."""
    label = F.col(label) if isinstance(label, str) else label
    known = F.when(label.isin(*labels), label).otherwise(labels[0])
    return [(known == x).cast("double").alias(f"regime_{x}") for x in labels]
