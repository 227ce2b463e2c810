"""Windows over one long ordered stream, in blocks of its order column.

A window over a whole run or signal is one task however long it is. Here the
rows are dealt into blocks of ``span`` of a numeric order column; a table of one
row a block carries what a row needs from the blocks before its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
#: Width of a block in units of the order column, and rows of a block once rows are numbered.
SPAN, ROWS = 65_536.0, 65_536


def dealt(rows: DataFrame, order: str, span: float = SPAN) -> DataFrame:
    """Add the block of each row."""
    return rows.withColumn(BLOCK, F.floor(F.col(order) / span))


def with_earlier(rows: DataFrame, keys: Sequence[str], last: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None) -> DataFrame:
    """Add what earlier blocks hold: of ``last`` (aggregates of a block) the newest that is not null, of ``total`` the sum. Null keys are a key."""
    last, total = last or {}, total or {}
    blocks = rows.groupBy(*keys, BLOCK).agg(*[c.alias(n) for n, c in (*last.items(), *total.items())])
    w = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    on = [*keys, BLOCK]
    known = blocks.select(
        *[F.col(c).alias(f"_at_{c}") for c in on], *[F.last(n, ignorenulls=True).over(w).alias(n) for n in last],
        *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in total])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in on])
    return rows.join(known, same).drop(*[f"_at_{c}" for c in on])


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], span: float = SPAN, name: str = "_n") -> DataFrame:
    """Add the place of each row in its key's order, from 0. The first column of ``order`` is numeric."""
    placed = with_earlier(dealt(rows, order[0], span), keys, total={"_before": F.count("*")})
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    return placed.withColumn(name, F.col("_before") + F.row_number().over(w) - 1).drop("_before", BLOCK)


def looking_back(placed: DataFrame, reach: int, rows: int = ROWS, name: str = "_n") -> DataFrame:
    """Deal numbered rows into blocks of ``rows``, each with the ``reach`` rows before it; ``_own`` is false for those."""
    size = max(rows, reach)
    own = F.floor(F.col(name) / size)
    blocks = F.when(F.col(name) % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    dealt_rows = placed.withColumn("_home", own).withColumn(BLOCK, F.explode(blocks))
    return dealt_rows.withColumn("_own", F.col("_home") == F.col(BLOCK)).drop("_home")


def with_totals(rows: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Add aggregates over all rows of a key: a partial aggregate and a join of one row a key, not a window that holds the key in a task."""
    found = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()]).select(*[F.col(c).alias(f"_of_{c}") for c in keys], *totals)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], F.lit(True))
    return rows.join(found, same, "left").drop(*[f"_of_{c}" for c in keys])


def within(
    rows: DataFrame, keys: Sequence[str], order: str, seconds: float, reach: int, add: Callable[[DataFrame, list[str]], DataFrame],
    size: int = ROWS, span: float = SPAN, ts: str = "ts") -> DataFrame:
    """``add(rows, keys)`` for windows that look back ``reach`` rows and ``seconds`` of ``ts``, one long key in many tasks.

    ``add`` is called once with rows dealt into blocks of about ``size`` and
    keys with the block among them; it must add columns by windows over those
    keys that reach no further, and keep all rows. A block also holds what its
    rows look back on, as copies that are left out afterwards. Rows of one
    ``ts`` are in one block, so a frame by range has all its peers. ``order``
    rises with ``ts``; rows without ``ts`` have a block of their own.
    """
    by_time = Window.partitionBy(*keys, BLOCK).orderBy(ts)
    placed = with_earlier(dealt(rows, ts, span), keys, total={"_before": F.count("*")})
    placed = placed.withColumns({
        "_place": F.col("_before") + F.row_number().over(by_time.orderBy(ts, order)) - 1,
        "_home": F.when(F.col(ts).isNotNull(), F.floor((F.col("_before") + F.rank().over(by_time) - 1) / size)),
    }).drop("_before", BLOCK)
    # One row a block: which later blocks may look back on some row of it.
    starts = placed.filter(F.col(ts).isNotNull()).groupBy(*keys, "_home").agg(F.min("_place").alias("_first"), F.min(ts).alias("_since"))
    entry = F.collect_list(F.struct("_home", "_first", "_since"))
    of_key = Window.partitionBy(*keys)
    by_ts, by_rows = (entry.over(of_key.orderBy(c).rangeBetween(0, far)) for c, far in (("_since", int(seconds)), ("_first", reach)))
    later = F.lead(F.array_union("_by_ts", "_by_rows")).over(of_key.orderBy("_home"))
    near = starts.withColumns({"_by_ts": by_ts, "_by_rows": by_rows}).select(*[F.col(c).alias(f"_at_{c}") for c in (*keys, "_home")], later.alias("_later"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in (*keys, "_home")])
    known = placed.join(near, same, "left").drop(*[f"_at_{c}" for c in (*keys, "_home")])
    needed = F.filter("_later", lambda b: (F.col("_place") >= b["_first"] - reach) | (F.col(ts) >= b["_since"] - int(seconds)))
    homes = F.concat(F.array("_home"), F.coalesce(F.transform(needed, lambda b: b["_home"]), F.array().cast("array<bigint>")))
    copies = known.withColumn(BLOCK, F.explode(homes)).withColumn("_mine", F.col(BLOCK).eqNullSafe(F.col("_home"))).drop("_place", "_home", "_later")
    return add(copies, [*keys, BLOCK]).filter("_mine").drop("_mine", BLOCK)
