"""Evidence at many times at once: every operator takes a table of asks (ask, now, focus, intent, question) and answers all of them in one job.

An ask sees nothing later than its ``now``. A window meets its rows by an
equi-join on cells of time, never by a range or cross join; what can be summed
up is summed up by cell first, so a row inside a window is read once however
many asks look at it, and only the two cells at a window's ends send rows.
``ask`` is unique; asks without a ``now`` have no evidence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import blocks
from tidegauge.functions.exprs import safe_corr
from tidegauge.operators import answers, order_stats, replies
from tidegauge.session import materialised

#: Cells of a window: more of them mean less raw rows at its ends and more summaries inside.
CELLS = 16


def _cell(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(float(width)))


def in_window(asks: DataFrame, rows: DataFrame, seconds: float, on: Sequence[str] = (), ts: str = "ts", cells: int = CELLS) -> DataFrame:
    """The rows of [now - seconds, now] of each ask, with the ask's columns; ``on`` are further columns that must be equal. Names must not clash."""
    width = seconds / cells
    near = asks.withColumn("_cell", F.explode(F.sequence(_cell(F.col("now") - seconds, width), _cell(F.col("now"), width))))
    return near.join(rows.withColumn("_cell", _cell(F.col(ts), width)), [*on, "_cell"]).filter(F.col(ts).between(F.col("now") - seconds, F.col("now"))).drop("_cell")


def summarised(asks: DataFrame, rows: DataFrame, seconds: float, keys: Sequence[str], value: str = "value", ts: str = "ts", cells: int = CELLS) -> DataFrame:
    """(ask, now, keys, n, mean, low, high, first_ts, last_ts, last, change, slope, latest) of the usable values in [now - seconds, now].

    ``change`` is the last value less the first, ``slope`` a second by least
    squares (0 without spread in time), ``latest`` the newest row (ts, value)
    with or without a value. Of rows with one ``ts`` the greater value is last
    and the least first. Sums are kept about a cell's start and moved to
    ``now`` when cells are put together.
    """
    width = seconds / cells
    x, y = F.col(ts) - F.col("_cell") * width, F.col(value)
    usable = y.isNotNull()
    at = F.struct(F.col(ts).alias("ts"), y.cast("double").alias("value"))
    held = {"_n": usable.cast("long"), "_x": F.when(usable, x), "_y": y, "_xx": F.when(usable, x * x), "_xy": x * y, "_low": y, "_high": y, "_first": F.when(usable, at), "_last": F.when(usable, at), "_latest": at}
    merge = {"_low": F.min, "_high": F.max, "_first": F.min, "_last": F.max, "_latest": F.max}
    gathered = [merge.get(c, F.sum)(c).alias(c) for c in held]
    single = rows.filter(F.col(ts).isNotNull()).withColumn("_cell", _cell(F.col(ts), width)).select(*keys, "_cell", *[c.alias(n) for n, c in held.items()])
    whole = single.groupBy(*keys, "_cell").agg(*gathered)
    first, last = _cell(F.col("now") - seconds, width), _cell(F.col("now"), width)
    mine = asks.select("ask", "now")
    inner = mine.withColumn("_cell", F.explode(F.filter(F.sequence(first, last), lambda c: (c > first) & (c < last))))
    ends = mine.withColumn("_cell", F.explode(F.array_distinct(F.array(first, last))))
    inside = F.col("_latest")["ts"].between(F.col("now") - seconds, F.col("now"))
    met = ends.join(single, "_cell").filter(inside).unionByName(inner.join(whole, "_cell"))
    d = F.col("_cell") * width - F.col("now")
    moved = met.withColumns({"_xx": F.col("_xx") + 2 * d * F.col("_x") + F.col("_n") * d * d, "_xy": F.col("_xy") + d * F.col("_y"), "_x": F.col("_x") + F.col("_n") * d})
    one = moved.groupBy("ask", "now", *keys).agg(*gathered)
    n, spread = F.col("_n"), F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x")
    level = F.when(spread > 1e-9 * F.col("_n") * F.col("_xx"), F.try_divide(n * F.col("_xy") - F.col("_x") * F.col("_y"), spread))
    return one.select(
        "ask", "now", *keys, n.alias("n"), F.try_divide("_y", n).alias("mean"), F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_first.ts").alias("first_ts"), F.col("_last.ts").alias("last_ts"), F.col("_last.value").alias("last"),
        (F.col("_last.value") - F.col("_first.value")).alias("change"), F.when(n > 0, F.coalesce(level, F.lit(0.0))).alias("slope"), F.col("_latest").alias("latest"))


def newest(asks: DataFrame, rows: DataFrame, ts: str, carry: Mapping[str, Column], strictly: bool = False, when: Column | None = None, span: float = blocks.SPAN) -> DataFrame:
    """(ask, carry) of the newest row not after ``when`` (``now`` unless given; before it with ``strictly``), null for none.

    Rows of one time are ordered by ``carry``. Asks and rows share blocks of
    time; a block is told what the blocks before it hold.
    """
    when = F.col("now") if when is None else when
    kind = F.struct(F.col(ts).cast("double").alias("_t"), *[c.alias(n) for n, c in carry.items()])
    seen = rows.filter(F.col(ts).isNotNull()).select(F.lit(None).cast("long").alias("ask"), F.col(ts).cast("double").alias("_t"), F.lit(0).alias("_side"), kind.alias("_seen"))
    asked = asks.select(F.col("ask").cast("long").alias("ask"), when.cast("double").alias("_t"), F.lit(-1 if strictly else 1).alias("_side"))
    both = blocks.dealt(seen.unionByName(asked.filter("_t IS NOT NULL"), allowMissingColumns=True), "_t", span)
    told = blocks.with_earlier(both, (), last={"_held": F.max("_seen")})
    w = Window.partitionBy(blocks.BLOCK).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = told.withColumn("_got", F.coalesce(F.max("_seen").over(w), "_held")).filter("ask IS NOT NULL")
    return found.select("ask", *[F.col("_got")[n].alias(n) for n in carry])


def _best(rows: DataFrame, by: Sequence[str], order: Sequence[Column], top: int) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_place") <= top).drop("_place")


def current(asks: DataFrame, rows: DataFrame, priority: Sequence[str]) -> DataFrame:
    """(ask, place, signal, value, ts, age): usable values of the newest tick not after ``now``, those of ``priority`` in its order, a focus outside it first."""
    at = newest(asks, rows.select("ts").distinct(), "ts", {"ts": F.col("ts")}).filter("ts IS NOT NULL").join(asks.select("ask", "now", "focus"), "ask")
    listed = F.array(*map(F.lit, priority))
    wanted = F.when(F.col("focus").isNull() | F.array_contains(listed, F.col("focus")), listed).otherwise(F.concat(F.array("focus"), listed))
    known = at.select("ask", "now", "ts", F.posexplode(wanted).alias("_pos", "signal"))
    met = known.join(rows.filter("value IS NOT NULL").select("signal", "ts", "value"), ["signal", "ts"])
    return met.select("ask", (F.col("_pos") + 1).alias("place"), "signal", "value", "ts", (F.col("now") - F.col("ts")).alias("age"))


def windows(asks: DataFrame, rows: DataFrame, seconds: float, general: Sequence[str], more: int = 3, alone: Sequence[str] = ()) -> DataFrame:
    """(ask, place, signal, n, mean, low, high, change) over the window: the focus first, then ``general`` signals in order, beside a focus ``more`` of them and beside one of ``alone`` none; two usable values at least."""
    listed = F.array(*map(F.lit, general))
    facts = summarised(asks, rows, seconds, ["signal"]).filter("n >= 2").join(asks.select("ask", "focus"), "ask")
    mine = facts.filter((F.col("signal") == F.col("focus")) | F.array_contains(listed, F.col("signal")))
    order = F.when(F.col("signal") == F.col("focus"), 0).otherwise(F.array_position(listed, F.col("signal")))
    of_ask = Window.partitionBy("ask")
    placed = mine.withColumns({"place": F.row_number().over(of_ask.orderBy(order)), "_own": F.coalesce(F.max((order == 0).cast("int")).over(of_ask), F.lit(0))})
    room = F.when(F.col("focus").isin(*alone), 0).otherwise(more) if alone else F.lit(more)
    kept = placed.filter(F.col("focus").isNull() | (F.col("place") <= room + F.col("_own")))
    return kept.select("ask", "place", "signal", "n", "mean", "low", "high", "change")


def levels(asks: DataFrame, rows: DataFrame, seconds: float, level: str, plug: str, power: str, to: Sequence[float] = (20.0, 10.0, 0.0), least: float = 1800.0) -> DataFrame:
    """(ask, per_minute, seconds, plugged, power, minutes_to_…): how a level falls over max(seconds, least), from four usable values on.

    Plugged is what ``plug`` says at the window's last tick; there and without a
    fall of over 1e-4 a minute no time to a level is given, nor to one already reached. Power is a mean, if over 0.
    """
    mine = summarised(asks, rows.filter(F.col("signal").isin(level, plug, power)), max(seconds, least), ["signal"])
    of = lambda name, c: F.max(F.when(F.col("signal") == name, F.col(c)))
    one = mine.groupBy("ask").agg(
        of(level, "n").alias("n"), (of(level, "slope") * 60).alias("per_minute"), (of(level, "last_ts") - of(level, "first_ts")).alias("seconds"), of(level, "last").alias("last"),
        F.max("latest.ts").alias("tick"), of(plug, "latest").alias("plug"), of(power, "mean").alias("power"))
    plugged = F.coalesce((F.col("plug.ts") == F.col("tick")) & (F.col("plug.value") > 0.5), F.lit(False))
    falls = ~plugged & (F.col("per_minute") < -1e-4)
    wait = {f"minutes_to_{x:g}": F.when(falls & (F.col("last") > x), (F.col("last") - x) / -F.col("per_minute")) for x in to}
    return one.filter("n >= 4").select("ask", "per_minute", "seconds", plugged.alias("plugged"), F.when(F.col("power") > 0, F.col("power")).alias("power"), *[c.alias(n) for n, c in wait.items()])


def lag_steps(interval: float, longest: float = 120.0) -> list[int]:
    """Lags in rows that are tried: about seven up to ``longest`` seconds at one row in ``interval`` seconds."""
    most = max(0, int(longest / max(interval, 1e-6)))
    return list(range(0, most + 1, max(1, most // 6)))


def drivers(asks: DataFrame, ticks: DataFrame, candidates: Sequence[str], seconds: float, interval: float, longest: float = 120.0, least: int = 12, weakest: float = 0.3, top: int = 4) -> DataFrame:
    """(ask, place, driver, lag_s, n, r, change) of the candidates that moved with the focus, each at its best lag (ties: the shortest).

    ``ticks`` (signal, ts, value) have one row a tick and signal, one tick in
    ``interval`` seconds; a lag counts ticks, and both ends lie in the window.
    The table is made wide and shifted once; asks meet a tick, not its signals.
    """
    lags = lag_steps(interval, longest)
    names = list(dict.fromkeys(candidates))
    wide = ticks.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("signal", "value")))).alias("_all"), *[F.max(F.when(F.col("signal") == s, F.col("value"))).alias(f"_s{i}") for i, s in enumerate(names)])
    placed = blocks.looking_back(blocks.numbered(wide, (), ["ts"]), max(lags))
    w = Window.partitionBy(blocks.BLOCK).orderBy("_n")
    ago = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    cell = lambda i, s, k: F.struct(F.lit(s).alias("driver"), F.lit(k).alias("lag"), ago(f"_s{i}", k).alias("x"), ago("ts", k).alias("since"))
    shifted = placed.select("_own", "ts", "_all", F.array(*[cell(i, s, k) for i, s in enumerate(names) for k in lags]).alias("_cells")).filter("_own").drop("_own")
    met = in_window(asks.filter("focus IS NOT NULL").select("ask", "now", "focus"), shifted, seconds).withColumn("y", F.try_element_at("_all", "focus")).filter("y IS NOT NULL")
    pairs = met.select("ask", "now", "focus", "y", F.inline("_cells")).filter((F.col("driver") != F.col("focus")) & F.col("x").isNotNull() & (F.col("since") >= F.col("now") - seconds))
    tried = pairs.groupBy("ask", "driver", "lag").agg(F.count("*").alias("n"), safe_corr("x", "y").alias("r")).filter((F.col("n") >= least) & F.col("r").isNotNull())
    best = tried.groupBy("ask", "driver").agg(F.max_by(F.struct("lag", "n", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("lag"))).alias("_b")).select("ask", "driver", "_b.*").filter(F.abs("r") >= weakest)
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc(F.round(F.abs("r"), 9)), "driver"))).filter(F.col("place") <= top)
    moved = summarised(asks, ticks.filter(F.col("signal").isin(names)), seconds, ["signal"]).filter("n >= 2").select("ask", F.col("signal").alias("driver"), "change")
    return ranked.join(moved, ["ask", "driver"], "left").select("ask", "place", "driver", (F.col("lag") * float(interval)).alias("lag_s"), "n", "r", F.coalesce("change", F.lit(0.0)).alias("change"))


def open_forecasts(asks: DataFrame, predictions: DataFrame, longest: float, prefer: str, latest: int = 400) -> DataFrame:
    """(ask, signal, horizon, arm, ts, ts_target, predicted, …) of each scope, of the ``latest`` forecasts open at ``now``: arm ``prefer``'s, else the newest; of a focus alone where there is one.

    ``longest`` bounds the horizons. Forecasts of one time count by signal, horizon and arm.
    """
    met = in_window(asks.select("ask", "now", "focus"), predictions, longest).filter(F.col("ts_target") > F.col("now"))
    held = _best(met, ["ask"], [F.desc("ts"), F.col("signal"), F.col("horizon"), F.col("arm")], latest)
    mine = held.filter(F.col("focus").isNull() | (F.col("signal") == F.col("focus")))
    return _best(mine, ["ask", "signal", "horizon"], [F.desc(F.col("arm") == prefer), F.desc("ts"), F.col("arm")], 1).drop("now", "focus")


def accuracy(asks: DataFrame, scored: DataFrame, seconds: float, least: int = 10, shortest: float = 7200.0, reference: str = "persistence") -> DataFrame:
    """(ask, arm, signal, horizon, n, mae, skill) of forecasts that came due in max(seconds, shortest), ``least`` of a group at least; of a focus alone where there is one."""
    by = ["signal", "horizon"]
    sums = summarised(asks, scored.select("arm", *by, F.col("ts_target").alias("ts"), F.col("abs_error").alias("value")), max(seconds, shortest), ["arm", *by]).select("ask", "arm", *by, "n", F.col("mean").alias("mae"))
    ref = sums.filter(F.col("arm") == reference).select("ask", *by, F.col("mae").alias("_ref"))
    skilled = sums.join(ref, ["ask", *by], "left").filter(F.col("n") >= least).join(asks.select("ask", "focus"), "ask").filter("focus IS NULL OR signal = focus")
    return skilled.select("ask", "arm", *by, "n", "mae", F.when(F.col("_ref") > 0, 1 - F.try_divide("mae", "_ref")).alias("skill"))


def history(asks: DataFrame, resolved: DataFrame, horizon: float, seconds: float = 604_800.0, least: int = 12) -> DataFrame:
    """(ask, n, p10, median, p90) of how the focus moved over ``horizon`` in the ask's regime, in the last ``seconds``.

    ``asks`` also have a regime; ``resolved`` (signal, regime, horizon, ts_target, anchor, actual) are rows of one arm. The quantiles are exact, so a row meets every ask whose window and regime
    it shares: asks times rows in the worst case, which a bound on the number of asks bounds.
    """
    mine = asks.filter("focus IS NOT NULL AND regime IS NOT NULL").select("ask", "now", F.col("focus").alias("signal"), "regime")
    moves = resolved.filter((F.col("horizon") == float(horizon)) & F.col("actual").isNotNull() & F.col("anchor").isNotNull()).select("signal", "regime", F.col("ts_target").alias("ts"), (F.col("actual") - F.col("anchor")).alias("move"))
    q = order_stats.quantiles(in_window(mine, moves, seconds, ["signal", "regime"]).select("ask", "move"), ["ask"], "move", [0.1, 0.5, 0.9], order_stats.FEW).filter(F.col("n") >= least)
    return q.select("ask", "n", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("p10", "median", "p90"))])


def regimes(asks: DataFrame, forecasts: DataFrame, labels: Sequence[str], seconds: float, limit: int = 4000, span: float = blocks.SPAN) -> DataFrame:
    """(ask, regime, since_s, shares): the regime at ``now``, how long it has held, and the share of each label in the window.

    ``forecasts`` (id, ts, ts_target, regime) are those of one arm and horizon. The regime is that of the newest one still open, else of the last
    that came due; the window takes the first ``limit`` that came due in it. Counts by label run over all rows, so a window of any length is two
    looks at a running count, which is written once; it reaches back no further than the window.
    """
    counts = {f"_c{i}": (F.col("regime") == x).cast("long") for i, x in enumerate(labels)}
    placed = materialised(blocks.numbered(forecasts.select("id", "ts", "ts_target", "regime").withColumns(counts), (), ["ts_target", "id"], span), "placed")
    dealt = blocks.dealt(placed, "ts_target", span)
    w = Window.partitionBy(blocks.BLOCK).orderBy("_n")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    was = blocks.with_earlier(dealt, (), last={"_was": F.max_by("regime", "_n")}, total={f"_t{i}": F.sum(c) for i, c in enumerate(counts)})
    fresh = was.withColumn("_fresh", F.when(~F.col("regime").eqNullSafe(F.coalesce(F.lag("regime").over(w), "_was")), F.col("ts")))
    known = blocks.with_earlier(fresh, (), last={"_began": F.max("_fresh")})
    running = F.array(*[F.col(f"_t{i}") + F.sum(c).over(to_here) for i, c in enumerate(counts)])
    rows = materialised(known.select("_n", "ts", "regime", F.coalesce(F.max("_fresh").over(to_here), "_began").alias("_since"), running.alias("_running"), F.array(*counts).alias("_own_counts")), "running")
    place = {"_place": F.col("_n") + 1}
    low = newest(asks, placed, "ts_target", place, strictly=True, when=F.col("now") - seconds, span=span).select("ask", F.coalesce("_place", F.lit(0)).alias("_a"))
    high = newest(asks, placed, "ts_target", place, span=span).select("ask", F.coalesce("_place", F.lit(0)).alias("_b"))
    ends = low.join(high, "ask").select("ask", "_a", F.least("_b", F.col("_a") + limit).alias("_b"))
    open_ = newest(asks, placed, "ts", {"_due": F.col("ts_target"), "_open": F.col("regime")}, span=span)
    held = ends.filter("_b > _a")
    first = held.join(rows.select(F.col("_n").alias("_a"), F.col("ts").alias("_from"), F.transform(F.arrays_zip("_running", "_own_counts"), lambda p: p["_running"] - p["_own_counts"]).alias("_before")), "_a").select("ask", "_from", "_before")
    last = held.join(rows.select((F.col("_n") + 1).alias("_b"), F.col("ts").alias("_last"), F.col("regime").alias("_last_regime"), "_since", "_running"), "_b").select("ask", (F.col("_b") - F.col("_a")).alias("_rows"), "_last", "_last_regime", "_since", "_running")
    one = asks.select("ask", "now").join(open_, "ask", "left").join(first, "ask", "left").join(last, "ask", "left")
    regime = F.coalesce(F.when(F.col("_due") > F.col("now"), F.col("_open")), "_last_regime", F.lit("unknown"))
    began = F.when(regime == F.col("_last_regime"), F.greatest("_since", "_from")).otherwise(F.col("_last"))
    shares = [((F.col("_running")[i] - F.col("_before")[i]) / F.col("_rows")).alias(x) for i, x in enumerate(labels)]
    return one.select("ask", regime.alias("regime"), F.greatest(F.lit(0.0), F.col("now") - began).alias("since_s"), F.when(F.col("_rows").isNotNull(), F.struct(*shares)).alias("shares"))


def events(asks: DataFrame, drift: DataFrame, adaptations: DataFrame, seconds: float = 21_600.0, each: int = 20, top: int = 12) -> DataFrame:
    """(ask, place, kind, id, ts, what): the newest ``top`` of the ``each`` newest rows of two logs (id, ts, what), skipped adaptations left out after they were counted. Drift goes before an adaptation of its time."""
    mine = asks.select("ask", "now")
    both = drift.select(F.lit("drift").alias("kind"), "id", "ts", "what").unionByName(adaptations.select(F.lit("adaptation").alias("kind"), "id", "ts", "what"))
    held = _best(in_window(mine, both, seconds), ["ask", "kind"], [F.desc("ts"), F.desc("id")], each).filter("kind = 'drift' OR what IS DISTINCT FROM 'skipped'")
    order = Window.partitionBy("ask").orderBy(F.desc("ts"), F.desc("kind"), F.desc("id"))
    return held.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("ask", "place", "kind", "id", "ts", "what")


def said(asks: DataFrame, feedback: DataFrame, scanned: int = 60, limit: int = 8, span: float = blocks.SPAN) -> DataFrame:
    """(ask, place, id, line) of the newest labels and notes with text among the ``scanned`` newest rows of feedback (id, ts, kind, text) not after ``now``; rows are met by their place, not by time."""
    placed = blocks.numbered(feedback.select("id", "ts", "kind", "text"), (), ["ts", "id"], span)
    last = newest(asks, placed, "ts", {"_last": F.col("_n")}, span=span).filter("_last IS NOT NULL")
    near = last.withColumn("_n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_last") - (scanned - 1)), F.col("_last"))))
    text = answers.stripped("text")
    told = near.join(placed.filter(F.col("kind").isin("label", "note") & (text != "")), "_n")
    line = F.concat(F.when(F.col("kind") == "label", 'User labels this behaviour: "').otherwise('User note: "'), text, F.lit('"'))
    return told.withColumn("place", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("_n")))).filter(F.col("place") <= limit).select("ask", "place", "id", line.alias("line"))


#: The intents that ask for each part of a pack.
WANTED = {
    "levels": ("battery", "status", "forecast"), "forecasts": ("forecast", "battery", "status", "trend"), "accuracy": ("forecast_error", "adaptation", "status", "anomaly"),
    "history": ("why_change", "trend", "anomaly", "forecast", "battery"), "events": ("anomaly", "adaptation", "forecast_error", "status"),
}
#: Intents and words of a question that ask for drivers.
DRIVER_INTENTS, DRIVER_WORDS = ("why_change", "trend", "anomaly"), ("why", "cause", "reason", "what made")


def wants(part: str) -> Column:
    """Whether an ask (intent, question) takes a part."""
    if part == "drivers":
        return F.col("intent").isin(*DRIVER_INTENTS) | reduce(lambda a, b: a | b, [F.contains(F.lower("question"), F.lit(x)) for x in DRIVER_WORDS])
    return F.col("intent").isin(*WANTED[part]) if part in WANTED else F.lit(True)


def packs(asks: DataFrame, parts: Mapping[str, DataFrame], stale: float = 30.0) -> DataFrame:
    """The asks, each with an array of the rows of every part (ask, …) in their order, and notes: ``stale`` telemetry, ``no_drivers``, ``no_forecasts``, or ``no_telemetry`` alone.

    Parts are bounded by their operators. A part that an ask does not want is
    empty, and so are all parts but the regime's where nothing is current.
    """
    pack = asks
    for name, rows in parts.items():
        own = [c for c in rows.columns if c != "ask"]
        listed = rows.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct(*own))).alias(name))
        pack = pack.join(listed, "ask", "left")
        empty = F.array().cast(listed.schema[name].dataType)
        pack = pack.withColumn(name, F.when(wants(name), F.coalesce(F.col(name), empty)).otherwise(empty))
    lively = F.size("current") > 0
    for name, rows in parts.items():
        if name not in ("current", "regime"):
            pack = pack.withColumn(name, F.when(lively, F.col(name)).otherwise(F.array().cast(pack.schema[name].dataType)))
    notes = [F.when(F.col("current")[0]["age"] > stale, "stale")]
    if "drivers" in parts:
        notes.append(F.when(wants("drivers") & F.col("focus").isNotNull() & (F.size("drivers") == 0), "no_drivers"))
    if "forecasts" in parts:
        notes.append(F.when(wants("forecasts") & (F.size("forecasts") == 0), "no_forecasts"))
    return pack.withColumn("notes", F.when(lively, F.array_compact(F.array(*notes))).otherwise(F.array(F.lit("no_telemetry"))))


def stamps(spark: SparkSession, rows: DataFrame, n: int, gap: float = 60.0, warm: float = 1200.0) -> DataFrame:
    """(ask, now): at most ``n`` times, ``gap`` seconds apart or more, evenly over the rows' range after ``warm`` seconds (at most a quarter of it); none where the range is a point."""
    ends = rows.agg(F.min("ts").cast("double").alias("_lo"), F.max("ts").cast("double").alias("_hi"))
    start = F.least(F.col("_lo") + warm, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * 0.25)
    plan = ends.select(start.alias("_from"), "_hi").filter("_hi > _from").withColumn("_step", F.greatest(F.lit(float(gap)), (F.col("_hi") - F.col("_from")) / max(n, 1)))
    # One row of ends, known to every task.
    dealt = spark.range(max(n, 0)).withColumnRenamed("id", "ask").join(F.broadcast(plan), F.lit(True))
    return dealt.withColumn("now", F.col("_from") + F.col("ask") * F.col("_step")).filter("now <= _hi").select("ask", "now")


def asked(times: DataFrame, questions: Sequence[str], labels: Mapping[str, str], seed: int = 1337, level: str | None = None) -> DataFrame:
    """(ask, now, question, intent, focus): each time with a question drawn by a hash of seed and ask. A question about the battery without a signal is about ``level``."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("ask").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % len(questions)
    rows = times.withColumn("question", F.array(*map(F.lit, questions))[drawn.cast("int")])
    named = rows.withColumns({"intent": answers.intent("question"), "focus": answers.focus("question", labels, available=list(labels))})
    return named if level is None else named.withColumn("focus", F.coalesce("focus", F.when(F.col("intent") == "battery", F.lit(level))))


def surface(names: Mapping[str, Sequence[str]]) -> Column:
    """The numbers of a pack that an answer may say: the named fields of each part, nulls left out."""
    field = lambda part, f: F.transform(F.col(part), lambda x: x[f].cast("double"))
    return F.array_compact(F.concat(*[field(part, f) for part, fields in names.items() for f in fields]))


def examples(packed: DataFrame, target: Column, numbers: Column, train: float = 0.7, shortest: int = 20) -> DataFrame:
    """(ask, now, question, intent, focus, target, surface, split): packs with something current and a target of ``shortest`` characters or more, the first share ``train`` by time for training."""
    kept = packed.filter(F.size("current") > 0).select("ask", "now", "question", "intent", "focus", target.alias("target"), numbers.alias("surface")).filter(F.length("target") >= shortest)
    placed = blocks.with_totals(blocks.numbered(kept, (), ["now", "ask"]), (), _all=F.count("*"))
    return placed.withColumn("split", F.when(F.col("_n") < F.floor(F.col("_all") * train), "train").otherwise("test")).drop("_n", "_all")


def answer(seconds: float, sentences: int = 4, labels: Mapping[str, str] | None = None) -> Column:
    """The answer that a pack (current, window, levels, drivers, forecasts, accuracy, history, events) gives, from its facts alone."""
    label = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in (labels or {"": ""}).items() for x in p]), c), c)
    head = lambda part: F.get(F.col(part), F.lit(0))
    now, change, level, driver, forecast, past, event = map(head, ("current", "window", "levels", "drivers", "forecasts", "history", "events"))
    best = F.get(F.array_sort(F.transform("accuracy", lambda a: F.struct(a["mae"].alias("mae"), a["arm"].alias("arm"), a["signal"].alias("signal")))), F.lit(0))
    waits = {int(n.removeprefix("minutes_to_")): level[n] for n in ("minutes_to_20", "minutes_to_10", "minutes_to_0")}
    clauses = {
        "now": replies.now_clause(label(now["signal"]), now["value"]), "change": replies.change_clause(change["change"], seconds), "battery": F.when(level.isNotNull(), replies.battery_clause(level["plugged"].cast("double"), level["per_minute"], waits)),
        "driver": replies.driver_clause(label(driver["driver"]), driver["r"], driver["lag_s"]), "forecast": replies.forecast_clause(label(forecast["signal"]), forecast["horizon"], forecast["predicted"]),
        "accuracy": F.when(best.isNotNull(), F.concat(F.lit("The least mean error is "), replies.one_decimal(best["mae"]), F.lit(", of "), best["arm"], F.lit("."))),
        "history": F.when(past.isNotNull(), F.concat(F.lit("At times like this its median change was "), replies.one_decimal(past["median"]), F.lit("."))),
        "event": F.when(event.isNotNull(), F.concat(F.lit("The newest event is a "), event["kind"], F.lit(" "), replies.duration(F.col("now") - event["ts"]), F.lit(" ago.")))}
    return replies.assembled(F.col("intent"), clauses, F.lit("Nothing is known for this question yet."), sentences)
