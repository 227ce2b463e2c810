"""Exact order statistics of groups of any size, quantiles and seeded samples built on them.

``percentile`` and sorting both hold a whole group in one task. Here the groups
with more than ``FEW`` values are refined together: a round counts the values
of every range still in question in ``BINS`` bins, as partial sums, and keeps
the bin that holds the wanted rank, with its least and greatest value. A group
is settled when its range is one value or holds at most ``FEW``. Nothing larger
than ``BINS`` counts a range or ``FEW`` values of a group is ever in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import materialised

FEW = 50_000
BINS = 1_024
#: Ranges that are sent to every task; with more of them rows meet ranges by a shuffle join.
BROADCAST_RANGES = 200_000


def _meet(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of the groups that have ranges, each with the ranges that it lies in."""
    sent = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
    return rows.join(sent, (F.col("_g") == F.col("_h")) & F.col("_x").between(F.col("_low"), F.col("_high"))).drop("_h")


def _at_ranks(rows: DataFrame, wanted: DataFrame, few: int, bins: int) -> DataFrame:
    """(_g, _rank, _value): the value of each wanted rank (from 0). ``rows`` has _g, _x; ``wanted`` _g, _rank, _low, _high, _n: the ends and size of the group."""
    open_ = wanted.withColumn("_before", F.lit(0).cast("long"))
    done = []
    # Bins of equal width, and every other round of equal ratio, so that long tails take few rounds too.
    # The logarithm of the least double is -744.4.
    scaled = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) + 745.0))
    for turn in count():
        known = (F.col("_low") == F.col("_high")) | (F.col("_n") <= few)
        done.append(open_.filter(known))
        left = open_.filter(~known)
        if not left.take(1):
            break
        ranges = materialised(left.select(F.col("_g").alias("_h"), "_low", "_high", "_before").distinct(), "ranges")
        x, low, high = (F.col(c) if turn % 2 == 0 else scaled(F.col(c)) for c in ("_x", "_low", "_high"))
        place = F.least(F.coalesce(F.floor(F.try_divide(x - low, high / bins - low / bins)), F.lit(0)), F.lit(bins - 1))
        counted = _meet(rows, ranges).groupBy("_g", "_low", "_high", "_before", place.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        earlier = F.coalesce(F.sum("_c").over(Window.partitionBy("_g", "_low", "_high").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("_start", F.col("_before") + earlier).drop("_before", "_bin")
        met = left.drop("_n", "_before").join(counted, ["_g", "_low", "_high"]).filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c")))
        open_ = materialised(met.select("_g", "_rank", F.col("_a").alias("_low"), F.col("_b").alias("_high"), F.col("_c").alias("_n"), F.col("_start").alias("_before")), "refined")
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    single = settled.filter("_low = _high").select("_g", "_rank", F.col("_low").alias("_value"))
    several = settled.filter("_low < _high")
    ranges = materialised(several.select(F.col("_g").alias("_h"), "_low", "_high", "_before").distinct(), "ranges")
    # At most ``few`` values a range.
    values = _meet(rows, ranges).groupBy("_g", "_low", "_high").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    picked = several.join(values, ["_g", "_low", "_high"]).select("_g", "_rank", F.get("_xs", (F.col("_rank") - F.col("_before")).cast("int")).alias("_value"))
    return single.unionByName(picked)


def _grouped(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    return rows.select(F.struct(*[F.col(c).alias(c) for c in by] or [F.lit(1).alias("all")]).alias("_g"), value.cast("double").alias("_x")).filter("_x IS NOT NULL AND abs(_x) < double('infinity')")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], few: int = FEW, bins: int = BINS) -> DataFrame:
    """(by, n, quantiles): the linear quantiles of ``shares`` of each group's finite values, exact for groups of any size. Null keys are keys."""
    held = materialised(_grouped(rows, by, F.col(value)), "values")
    sizes = held.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    names = [F.col("_g")[c].alias(c) for c in by]
    large = materialised(sizes.filter(F.col("_n") > few), "large")
    many = large.count()
    if not many:
        return held.groupBy("_g").agg(F.count("*").alias("n"), F.percentile("_x", list(shares)).alias("quantiles")).select(*names, "n", "quantiles")
    keys = large.select("_g")
    keys = F.broadcast(keys) if many <= BROADCAST_RANGES else keys
    small = held.join(keys, "_g", "left_anti").groupBy("_g").agg(F.count("*").alias("n"), F.percentile("_x", list(shares)).alias("quantiles"))
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares])))
    found = _at_ranks(held, large.select("_g", F.explode(ranks).alias("_rank"), "_low", "_high", "_n"), few, bins)
    at = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at")).join(large.select("_g", "_n"), "_g")

    def between(p: float) -> Column:
        low, high = F.element_at("_at", F.floor(place(p))), F.element_at("_at", F.ceil(place(p)))
        return low + (place(p) - F.floor(place(p))) * (high - low)

    big = at.select("_g", F.col("_n").alias("n"), F.array(*[between(p) for p in shares]).alias("quantiles"))
    return small.unionByName(big).select(*names, "n", "quantiles")


def priority(ids: Sequence[Column], seed: int) -> Column:
    """A number in [0, 2**52) from a row's ids, uniform and the same wherever the row is."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def reservoir(rows: DataFrame, by: Sequence[str], k: int, ids: Sequence[str], seed: int = 1337, few: int = FEW, bins: int = BINS) -> DataFrame:
    """``rows`` that a uniform sample of ``k`` of each group holds, with their ``_priority``: those of the k least priorities.

    The sample is a function of the rows alone: partitions and order do not
    matter, and samples of parts, put together and sampled again with the same
    k and seed, are the sample of the whole. ``ids`` tell rows apart; rows that
    share them are kept or left together.
    """
    placed = rows.withColumn("_priority", priority([F.col(c) for c in ids], seed))
    held = materialised(_grouped(placed, by, F.col("_priority")), "priorities")
    sizes = held.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")).filter(F.col("_n") > k)
    last = _at_ranks(held, materialised(sizes.select("_g", F.lit(k - 1).cast("long").alias("_rank"), "_low", "_high", "_n"), "wanted"), few, bins)
    last = materialised(last.select(F.col("_g").alias("_of"), F.col("_value").alias("_last")), "thresholds")
    sent = F.broadcast(last) if last.count() <= BROADCAST_RANGES else last
    group = F.struct(*[F.col(c).alias(c) for c in by] or [F.lit(1).alias("all")])
    return placed.join(sent, group == F.col("_of"), "left").filter("_last IS NULL OR _priority <= _last").drop("_of", "_last")


def drawn(fresh: DataFrame, kept: DataFrame, by: Sequence[str], n: int, share: float, ids: Sequence[str], order: str, seed: int) -> DataFrame:
    """A training batch of each group: a ``share`` of ``n`` drawn from the reservoir ``kept``, the rest the newest rows of ``fresh`` by ``order`` (ties: the greater ids).

    A group's reservoir is bounded, so is its part of ``fresh`` after the first
    step: each block of the order keeps at most ``n``.
    """
    w = Window.partitionBy(*by)
    old = kept.drop("_priority").withColumn("_p", priority([F.col(c) for c in ids], seed))
    old = old.withColumns({"_i": F.row_number().over(w.orderBy("_p", *ids)), "_all": F.count("*").over(w)}).withColumn("_k", F.least(F.col("_all"), F.round(F.lit(n * share)).cast("long")))
    old = old.filter("_i <= _k")
    sizes = old.groupBy(*by).agg(F.max("_k").alias("_k"))
    newest = [F.desc(order), *[F.desc(c) for c in ids]]
    part = fresh.withColumn("_part", F.pmod(F.xxhash64(*ids), F.lit(256)))
    first = part.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*newest))).filter(F.col("_i") <= n).drop("_part")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    sized = first.join(sizes.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_k"), same, "left").drop(*[f"_of_{c}" for c in by])
    new = sized.withColumn("_i", F.row_number().over(w.orderBy(*newest))).filter(F.col("_i") <= n - F.coalesce("_k", F.lit(0)))
    return new.drop("_i", "_k").withColumn("from_reservoir", F.lit(False)).unionByName(old.drop("_p", "_i", "_all", "_k").withColumn("from_reservoir", F.lit(True)))
