"""Order-dependent kernels over one long key in many tasks: block summaries, a fold over blocks, blocks replayed from their starts.

A key's rows are numbered and dealt into blocks. Each block is summarised on its
own: by a function of the state that the block begins in. A fold over the
blocks' summaries, one row a block, gives each block its starting state, and
then every block is replayed from it in a task of its own.

Where a summary leaves something out (``RlsScan``: that the covariance was
scaled back; ``PageHinkleyScan``: where in its block an alarm began afresh), a
block ends in another state than the next one was started from. Then the fold is
made again from the state that it really reached, and the blocks whose start
that changes are replayed once more, until every start is the end before it:
results never rest on a guess, and each round settles at least one more block.
What is still open after ``MOST_ROUNDS`` is replayed in one stream a key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import blocks
from tidegauge.operators import replay, states
from tidegauge.operators.sequential import Cooldown, Hysteresis, PageHinkley, RecursiveLeastSquares
from tidegauge.session import materialised, ship

BLOCK_ROWS = 8_192
MOST_ROUNDS = 12


class HysteresisScan:
    """A block as a function over (label, candidate, streak).

    Labels that the block never sees behave alike, so they are one symbol each
    for label and candidate, put back when the function is applied.
    """

    LABEL, CANDIDATE = "\0label", "\0candidate"

    def __init__(self, raw: str = "raw", needed: int = 3):
        self.raw, self.needed = raw, needed

    def summary(self, rows: list[dict]) -> str:
        raws = [r[self.raw] for r in rows]
        seen = sorted({*raws, "unknown"}, key=str)
        now = {(a, b, n): [(a, b, n)] for a in [*seen, self.LABEL] for b in [*seen, self.CANDIDATE] for n in range(self.needed)}
        one = Hysteresis(self.needed)
        for raw in raws:
            after: dict[tuple, list[tuple]] = {}
            for (one.label, one.candidate, one.streak), starts in now.items():
                one.step(raw)
                after.setdefault((one.label, one.candidate, one.streak), []).extend(starts)
            now = after
        return json.dumps({"seen": seen, "map": [[list(s), list(end)] for end, starts in now.items() for s in starts]})

    def advance(self, state: Hysteresis, summary: str) -> Hysteresis:
        found = json.loads(summary)
        symbol = lambda v, other: v if v in found["seen"] else other
        start = [symbol(state.label, self.LABEL), symbol(state.candidate, self.CANDIDATE), state.streak]
        end = next(e for s, e in found["map"] if s == start)
        out = Hysteresis(self.needed)
        own = {self.LABEL: state.label, self.CANDIDATE: state.candidate}
        out.label, out.candidate, out.streak = own.get(end[0], end[0]), own.get(end[1], end[1]), end[2]
        return out

    def same(self, a: Hysteresis, b: Hysteresis) -> bool:
        return vars(a) == vars(b)


class RlsScan:
    """A block as what it adds to the information matrix X'WX and to X'Wy, and by how much it fades what was there.

    This form is associative; the inverse of the matrix is the kernel's covariance.
    """

    def __init__(self, x: Sequence[str], y: str, forgetting: float = 1.0):
        self.x, self.y, self.forgetting = list(x), y, forgetting

    def summary(self, rows: list[dict]) -> str:
        x = np.array([[r[c] for c in self.x] for r in rows], float).reshape(len(rows), len(self.x))
        y = np.array([r[self.y] for r in rows], float)
        good = np.isfinite(x).all(axis=1) & np.isfinite(y)
        x, y = x[good], y[good]
        fading = self.forgetting ** np.arange(len(y) - 1, -1, -1)
        return json.dumps({"n": len(y), "skipped": int((~good).sum()), "information": ((x * fading[:, None]).T @ x).ravel().tolist(), "moment": (x.T @ (fading * y)).tolist()})

    def advance(self, state: RecursiveLeastSquares, summary: str) -> RecursiveLeastSquares:
        found, d = json.loads(summary), len(state.w)
        before = np.linalg.inv(state.p)
        faded = self.forgetting ** found["n"]
        after = faded * before + np.array(found["information"]).reshape(d, d)
        out = state.copy()
        out.p = np.linalg.inv(after)
        out.p = (out.p + out.p.T) / 2
        out.w = out.p @ (faded * before @ state.w + np.array(found["moment"]))
        out.updates, out.skipped = state.updates + found["n"], state.skipped + found["skipped"]
        return out

    def same(self, a: RecursiveLeastSquares, b: RecursiveLeastSquares) -> bool:
        close = lambda u, v: bool(np.abs(u - v).max() <= 1e-7 * max(np.abs(u).max(), 1e-300))
        return a.updates == b.updates and close(a.p, b.p) and np.abs(a.w - b.w).max() <= 1e-9 * max(np.abs(a.w).max(), 1.0)


Points = list[tuple[int, float]]


def upper_hull(points: Points) -> Points:
    """The points (x, y) that are greatest in y - c * x for some c, by x."""
    best: dict[int, float] = {}
    for x, y in points:
        if y > best.get(x, -np.inf):
            best[x] = y
    out: Points = []
    for x, y in sorted(best.items()):
        while len(out) > 1 and (out[-1][1] - out[-2][1]) * (x - out[-1][0]) <= (y - out[-1][1]) * (out[-1][0] - out[-2][0]):
            out.pop()
        out.append((x, y))
    return out


def hull_sum(a: Points, b: Points) -> Points:
    """The hull of all sums of a point of one hull and one of the other: their edges in the order of slope."""
    out, i, j = [(a[0][0] + b[0][0], a[0][1] + b[0][1])], 0, 0
    while i + 1 < len(a) or j + 1 < len(b):
        rise = lambda h, n: (h[n + 1][1] - h[n][1]) / (h[n + 1][0] - h[n][0]) if n + 1 < len(h) else -np.inf
        if rise(a, i) >= rise(b, j):
            i += 1
        else:
            j += 1
        out.append((a[i][0] + b[j][0], a[i][1] + b[j][1]))
    return out


def runs_hull(values: list[float]) -> tuple[Points, Points, Points, int, float]:
    """Hulls over (length, sum): of the beginnings, of the ends and of all runs of ``values``; their number and sum.

    For every level c at once they tell the greatest sum of value - c: of a run
    across the middle it is an end of the left half and a beginning of the right.
    """
    if len(values) == 1:
        one = [(1, values[0])]
        return one, one, one, 1, values[0]
    left, right = runs_hull(values[: len(values) // 2]), runs_hull(values[len(values) // 2 :])
    moved = lambda h, n, total: [(x + n, y + total) for x, y in h]
    begins = upper_hull(left[0] + moved(right[0], left[3], left[4]))
    ends = upper_hull(right[1] + moved(left[1], right[3], right[4]))
    return begins, ends, upper_hull(left[2] + right[2] + hull_sum(left[1], right[0])), left[3] + right[3], left[4] + right[4]


class PageHinkleyScan:
    """A block as what its sums can do, for any reference: the hulls of its beginnings and of its runs.

    With a ready reference of mean m and deviation s the detector adds
    (x - c) / s, c = m + delta * s, so that the hulls give the sum's end, its
    least and its greatest rise at any c, and whether the block has an alarm. A
    block with an alarm or a warm-up ends in a state that depends on where that
    is; the guess is the state of a run that begins afresh with the block.
    """

    def __init__(self, value: str, make: Callable[[], tuple], order: str):
        self.value, self.make, self.order = value, make, order

    def summary(self, rows: list[dict]) -> str:
        values = [float(r[self.value]) for r in rows]
        begins, _, runs, n, total = runs_hull(values)
        lowest = [(x, -y) for x, y in runs_hull([-v for v in values])[0]]
        fresh = self.make()
        for r, v in zip(rows, values, strict=True):
            if fresh[0].step(v)[0]:
                fresh[1].step("error", r[self.order])
        return json.dumps({"n": n, "total": total, "begins": begins, "lowest": lowest, "runs": runs, "fresh": states.encode(fresh)})

    def advance(self, state: tuple, summary: str) -> tuple:
        found = json.loads(summary)
        detector, cooldown = state
        reference = detector.reference
        if reference.ready:
            c = reference.mean + detector.delta * reference.deviation
            most = lambda h: max(y - c * x for x, y in h) / reference.deviation
            if max(most(found["runs"]), detector.sum - detector.least + most(found["begins"])) <= detector.threshold:
                out, cool = states.decode(states.encode((detector, cooldown)))
                low = min(y - c * x for x, y in found["lowest"]) / reference.deviation
                out.least = min(detector.least, detector.sum + low)
                out.sum = detector.sum + (found["total"] - c * found["n"]) / reference.deviation
                return out, cool
        return states.decode(found["fresh"])

    def same(self, a: tuple, b: tuple) -> bool:
        close = lambda u, v: u == v or u is not None and v is not None and abs(u - v) <= 1e-8 * max(1.0, abs(u))
        one, two = a[0], b[0]
        parts = lambda d: (d.sum, d.least, d.reference.n, d.reference.mean, d.reference.square, d.reference.deviation)
        return one.reference.ready == two.reference.ready and all(map(close, parts(one), parts(two))) and a[1].last == b[1].last


def _grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    from itertools import groupby

    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[tuple, list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` over each key's rows, in order, at once: for blocks and for one row a block."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _grouped(batches, keys):
            out = [dict(zip(names, o, strict=True)) for o in fn(key, list(group))]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=replay._arrow(schema))

    ship(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _met(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join on (key, _part), a null key being a key."""
    named = right.withColumnsRenamed({key: "_k", "_part": "_p"})
    return left.join(named, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), how).drop("_k", "_p")


def scanned(
    rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], scan, make: Callable[[tuple], object], step: Callable[[object, dict], tuple], schema: str,
    block_rows: int = BLOCK_ROWS, span: float = blocks.SPAN,
) -> tuple[DataFrame, int]:
    """The rows of ``replay.stepped`` (``schema`` begins with ``key``, then ``columns``), a key in many tasks; and the number of rounds of replay.

    Rows that equal each other in ``order`` stand in any order, as there. The
    first of ``order`` is a number. Keys are strings.
    """
    if not rows.take(1):
        return replay.stepped(rows, [key], order, columns, make, step, schema), 0
    placed = blocks.numbered(rows, [key], order, span).withColumn("_part", F.floor(F.col("_n") / block_rows)).drop("_n")
    placed = materialised(placed, "scan-rows")
    by = [key, "_part"]
    if not placed.filter("_part > 0").take(1):
        return replay.stepped(placed, [key], order, columns, make, step, schema), 1
    summaries = materialised(_per_key(placed, by, order, lambda k, group: iter([(*k, scan.summary(group))]), f"{key} string, _part long, summary string"), "scan-summaries")

    def fold(k: tuple, group: list[dict]) -> Iterator[tuple]:
        state = make(k)
        for row in group:
            state = states.decode(row["known"]) if row["known"] is not None else state
            yield (*k, row["_part"], states.encode(state))
            state = scan.advance(state, row["summary"])

    def first_wrong(k: tuple, group: list[dict]) -> Iterator[tuple]:
        for one, after in zip(group, group[1:], strict=False):
            if not scan.same(states.decode(one["ended"]), states.decode(after["state"])):
                yield (*k, after["_part"], one["ended"])
                return

    spark, rounds, tried, ends, found = rows.sparkSession, 0, None, None, []
    known = spark.createDataFrame([], f"{key} string, _part long, known string")
    out_schema = schema.replace(f"{key} string", f"{key} string, _part long", 1)
    names = [x.split()[0] for x in schema.split(", ")]
    while True:
        rounds += 1
        starts = materialised(_per_key(_met(summaries, known, key, "left"), [key], ["_part"], fold, f"{key} string, _part long, state string"), "scan-starts")
        changed = starts if tried is None else _met(starts, tried.withColumnRenamed("state", "old"), key, "inner").filter("state <> old").drop("old")
        tried = starts
        done, after, _ = replay.resumable(_met(placed, changed.select(*by), key, "left_semi"), by, order, columns, lambda k: make(k[:1]), step, out_schema, start=changed)
        found.append((done, changed.select(*by)))
        ends = after if ends is None else materialised(_met(ends, changed.select(*by), key, "left_anti").unionByName(after), "scan-ends")
        both = _met(starts, ends.withColumnRenamed("state", "ended"), key, "inner")
        wrong = materialised(_per_key(both, [key], ["_part"], first_wrong, f"{key} string, _part long, known string"), "scan-wrong")
        if not wrong.take(1):
            break
        if rounds == MOST_ROUNDS:
            first = wrong.select(F.col(key).alias("_key"), F.col("_part").alias("_from"))
            later = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") >= F.col("_from"))
            rest, _, _ = replay.resumable(placed.join(first, later, "left_semi"), [key], order, ["_part", *columns], make, step, out_schema, start=wrong.withColumnRenamed("known", "state"))
            found.append((rest, placed.join(first, later, "left_semi").select(*by).distinct()))
            break
        known = materialised(known.unionByName(wrong), "scan-known")
    # Of each block the rows of its last replay.
    out, newer = found[-1]
    for rows_, mine in reversed(found[:-1]):
        out, newer = out.unionByName(_met(rows_, newer, key, "left_anti")), newer.unionByName(mine)
    return out.select(names), rounds


def settled(rows: DataFrame, key: str = "run", order: str = "k", raw: str = "raw", needed: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(run, k, raw, regime): hysteresis of every run, a long run in many tasks."""
    schema = f"{key} string, {order} long, {raw} string, regime string"
    return scanned(rows.select(key, order, raw), key, [order, raw], [order, raw], HysteresisScan(raw, needed), lambda _: Hysteresis(needed), lambda state, row: (state.step(row[raw]),), schema, block_rows)[0]


def online_regression(examples: DataFrame, x: Sequence[str], y: str, key: str = "signal", order: str = "ts_target", ridge: float = 1.0, forgetting: float = 1.0, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """``replay.online_regression`` with a long scope in many tasks, equal within rounding; and the number of rounds."""
    rows, _, by, columns, make, step, schema = replay._regression(examples, x, y, key, order, ridge, forgetting)
    return scanned(rows, key, by, columns, RlsScan(x, y, forgetting), make, step, schema, block_rows)


def drift(errors: DataFrame, key: str = "signal", order: str = "ts_target", value: str = "abs_error", cooldown: float = 300.0, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """``replay.drift`` by Page-Hinkley with a long scope in many tasks; and the number of rounds."""
    make = lambda *_: (PageHinkley(), Cooldown(cooldown))

    def step(state: tuple, row: dict) -> tuple:
        alarm, statistic = state[0].step(row[value])
        return statistic, alarm, alarm and state[1].step("error", row[order])

    schema = f"{key} string, {order} double, statistic double, alarm boolean, event boolean"
    return scanned(errors.select(key, order, value), key, [order], [order], PageHinkleyScan(value, make, order), make, step, schema, block_rows)
