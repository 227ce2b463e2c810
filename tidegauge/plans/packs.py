"""Queries of evidence at many times and the language dataset made of it, each with DuckDB SQL written from the rules by plain range joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.exprs import rounded
from tidegauge.operators import evidence_at as at
from tidegauge.operators import regime
from tidegauge.plans.answering import _INTENT_SQL
from tidegauge.plans.serving import QUERIES, SQL
from tidegauge.plans.telemetry import BASE, GRID, HORIZON, HOUR, RAW_SQL, SIGNALS, forecasts, hourly, query, raw_regimes, scored
from tidegauge.sources.readings import readings, table
from tidegauge.session import materialised

DAY, WEEK = 24 * HOUR, 7 * 24 * HOUR
TIMES, GAP = 240, HOUR
#: Means of values with few decimals end in a 5 at the sixth or seventh place; they are rounded behind those.
MEAN_DIGITS = 9
LABELS = {s: s for s in SIGNALS}
QUESTIONS = (
    "Why did the click count change?", "Will the battery last another hour?", "How accurate were the view forecasts?", "Was the purchase count unusual?", "Has the model been adapting?",
    "Give me a status summary.", "Is the error count trending up?", "What is the signup forecast?", "Why are there so many view events?", "How was it, and for what reason?",
)
GENERAL, PRIORITY = ("view", "click", "error", "purchase"), ("view", "click", "error")
DRIVERS, LONGEST_LAG = ("view", "click", "error", "purchase", "signup"), 6 * HOUR
_LIST = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "]"
_FOCUS_SQL = "CASE " + " ".join(f"WHEN contains(q, '{s}') THEN '{s}'" for s in sorted(SIGNALS, key=lambda s: -len(s))) + " END"
ASKS_SQL = f"""ends AS (SELECT least(min(ts) + 1200, min(ts) + (max(ts) - min(ts)) * 0.25) AS lo, max(ts) AS hi FROM grid),
plan AS (SELECT lo, hi, greatest({GAP}, (hi - lo) / {TIMES}) AS step FROM ends WHERE hi > lo),
drawn AS (SELECT i AS ask, lo + i * step AS now, {_LIST}[CAST(('0x' || substr(md5('1337:' || i), 1, 8))::BIGINT % {len(QUESTIONS)} AS INTEGER) + 1] AS question FROM plan, range({TIMES}) t(i) WHERE lo + i * step <= hi),
named AS (SELECT *, {_INTENT_SQL} AS intent, {_FOCUS_SQL} AS found FROM (SELECT *, lower(question) AS q FROM drawn)),
asks AS (SELECT ask, now, question, intent, coalesce(found, CASE WHEN intent = 'battery' THEN 'view' END) AS focus FROM named)"""
ASKED = f"{GRID}, {ASKS_SQL}"


def asks(spark, sf_dir, rows=None):
    """Up to 240 times over the readings, an hour apart or more, each with a question."""
    times = at.stamps(spark, hourly(spark, sf_dir) if rows is None else rows, TIMES, GAP)
    return at.asked(times, QUESTIONS, LABELS, level="view")


@query("evidence_asks", f"WITH {ASKED} SELECT ask, round(now, 3) AS now, question, intent, focus FROM asks")
def evidence_asks(spark, sf_dir):
    return rounded(asks(spark, sf_dir), ["now"], 3)


CURRENT_SQL = f"""newest_tick AS (SELECT ask, any_value(now) AS now, any_value(focus) AS focus, max(ts) AS ts FROM asks JOIN grid ON ts <= now GROUP BY ask),
want AS (SELECT *, CASE WHEN focus IS NULL OR list_contains({list(PRIORITY)}, focus) THEN {list(PRIORITY)} ELSE list_concat([focus], {list(PRIORITY)}) END AS w FROM newest_tick),
current AS (SELECT ask, CAST(list_position(w, g.signal) AS INTEGER) AS place, g.signal, g.value, g.ts, now - g.ts AS age FROM want JOIN grid g ON g.ts = want.ts AND list_contains(w, g.signal) WHERE g.value IS NOT NULL)"""


@query("evidence_current_at", f"WITH {ASKED}, {CURRENT_SQL} SELECT ask, place, signal, round(value, 6) AS value, ts, round(age, 3) AS age FROM current")
def evidence_current_at(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return rounded(rounded(at.current(asks(spark, sf_dir, rows), rows, PRIORITY), ["value"]), ["age"], 3)


WINDOW_SQL = f"""span AS (SELECT ask, any_value(now) AS now, any_value(focus) AS focus, signal, count(value) AS n, avg(value) AS mean, min(value) AS low, max(value) AS high,
  arg_max(value, ts) FILTER (value IS NOT NULL) - arg_min(value, ts) FILTER (value IS NOT NULL) AS change FROM asks JOIN grid ON ts BETWEEN now - {DAY} AND now GROUP BY ask, signal HAVING count(value) >= 2),
mine AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY CASE WHEN signal = focus THEN 0 ELSE list_position({list(GENERAL)}, signal) END) AS place, CAST(max(CASE WHEN signal = focus THEN 1 ELSE 0 END) OVER (PARTITION BY ask) AS INTEGER) AS own
  FROM span WHERE signal = focus OR list_contains({list(GENERAL)}, signal)),
windows AS (SELECT ask, CAST(place AS INTEGER) AS place, signal, n, mean, low, high, change FROM mine WHERE focus IS NULL OR place <= own + CASE WHEN focus = 'view' THEN 0 ELSE 3 END)"""


@query("evidence_windows_at", f"WITH {ASKED}, {WINDOW_SQL} SELECT ask, place, signal, n, round(mean, 9) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(change, 6) + 0.0 AS change FROM windows")
def evidence_windows_at(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return rounded(at.windows(asks(spark, sf_dir, rows), rows, DAY, GENERAL, alone=("view",)).withColumn("mean", F.round("mean", MEAN_DIGITS)), ["low", "high", "change"])


def _levelled(rows):
    """``view`` stands for a level and ``error`` for power; ``signup`` over 50 stands for being plugged in."""
    return rows.withColumn("value", F.when(F.col("signal") == "signup", F.when(F.col("value") > 50, 1.0).otherwise(0.0)).otherwise(F.col("value")))


_WAIT_SQL = ", ".join(f"CASE WHEN NOT plugged AND per_minute < -1e-4 AND last > {x} THEN (last - {x}) / -per_minute END AS minutes_to_{x}" for x in (20, 10, 0))
LEVEL_SQL = f"""lv AS (SELECT ask, now, signal, ts, CASE WHEN signal = 'signup' THEN CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END ELSE value END AS value FROM asks JOIN grid ON ts BETWEEN now - {DAY} AND now WHERE signal IN ('view', 'signup', 'error')),
lf AS (SELECT ask, count(value) FILTER (signal = 'view') AS n, coalesce(regr_slope(value, ts - now) FILTER (signal = 'view'), 0) * 60 AS per_minute,
  max(ts) FILTER (signal = 'view' AND value IS NOT NULL) - min(ts) FILTER (signal = 'view' AND value IS NOT NULL) AS seconds, arg_max(value, ts) FILTER (signal = 'view' AND value IS NOT NULL) AS last,
  coalesce(arg_max(value, ts) FILTER (signal = 'signup') > 0.5, false) AS plugged, avg(value) FILTER (signal = 'error') AS power FROM lv GROUP BY ask),
levels AS (SELECT ask, per_minute, seconds, plugged, CASE WHEN power > 0 THEN power END AS power, {_WAIT_SQL} FROM lf WHERE n >= 4)"""


@query("evidence_levels_at", f"WITH {ASKED}, {LEVEL_SQL} SELECT ask, round(per_minute, 6) + 0.0 AS per_minute, seconds, plugged, round(power, 9) AS power, round(minutes_to_20, 3) AS minutes_to_20, round(minutes_to_10, 3) AS minutes_to_10, round(minutes_to_0, 3) AS minutes_to_0 FROM levels")
def evidence_levels_at(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    found = at.levels(asks(spark, sf_dir, rows), _levelled(rows), DAY, "view", "signup", "error")
    return rounded(rounded(found.withColumn("power", F.round("power", MEAN_DIGITS)), ["per_minute"]), [f"minutes_to_{x}" for x in (20, 10, 0)], 3)


DRIVER_SQL = f"""tk AS (SELECT DISTINCT ts, row_number() OVER (ORDER BY ts) AS n FROM (SELECT DISTINCT ts FROM grid)),
tv AS (SELECT n, g.ts, signal, value FROM grid g JOIN tk ON tk.ts = g.ts WHERE value IS NOT NULL),
dp AS (SELECT ask, x.signal AS driver, l.lag, x.value AS x, y.value AS y FROM asks JOIN tv y ON y.signal = focus AND y.ts BETWEEN now - {DAY} AND now JOIN (SELECT unnest({at.lag_steps(HOUR, LONGEST_LAG)}) AS lag) l ON true
  JOIN tv x ON x.n = y.n - l.lag AND x.signal <> focus AND x.ts >= now - {DAY}),
dc AS (SELECT ask, driver, lag, count(*) AS n, CASE WHEN stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS r FROM dp GROUP BY ALL HAVING count(*) >= 12),
db AS (SELECT *, row_number() OVER (PARTITION BY ask, driver ORDER BY round(abs(r), 9) DESC, lag) AS best FROM dc WHERE r IS NOT NULL),
dr AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY round(abs(r), 9) DESC, driver) AS place FROM db WHERE best = 1 AND abs(r) >= 0.3),
dm AS (SELECT ask, signal AS driver, arg_max(value, ts) - arg_min(value, ts) AS change FROM asks JOIN grid ON ts BETWEEN now - {DAY} AND now WHERE value IS NOT NULL GROUP BY ask, signal HAVING count(*) >= 2),
drivers AS (SELECT dr.ask, CAST(place AS INTEGER) AS place, dr.driver, lag * {HOUR} AS lag_s, n, r, coalesce(change, 0) AS change FROM dr LEFT JOIN dm ON dm.ask = dr.ask AND dm.driver = dr.driver WHERE place <= 3)"""


def _drivers(asked, rows):
    return at.drivers(asked, rows, DRIVERS, DAY, HOUR, LONGEST_LAG, top=3)


@query("evidence_drivers_at", f"WITH {ASKED}, {DRIVER_SQL} SELECT ask, place, driver, lag_s, n, round(r, 6) AS r, round(change, 6) + 0.0 AS change FROM drivers")
def evidence_drivers_at(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return rounded(_drivers(asks(spark, sf_dir, rows), rows), ["r", "change"])


#: Forecasts of an ask that are looked at: fewer than are open, so that the bound is met.
LATEST = 40
_BASE_ASKED = f"{BASE}, {ASKS_SQL}"
FORECAST_SQL = f"""arms AS (SELECT signal, ts, ts_target, CAST({HORIZON} AS DOUBLE) AS horizon, a.arm, a.predicted FROM base, LATERAL (VALUES ('persistence', persistence), ('moving_average', moving_average), ('ewma', ewma), ('linear_trend', linear_trend)) a(arm, predicted) WHERE a.predicted IS NOT NULL),
op AS (SELECT ask, focus, arms.*, row_number() OVER (PARTITION BY ask ORDER BY ts DESC, signal, horizon, arm) AS i FROM asks JOIN arms ON ts BETWEEN now - {HORIZON} AND now AND ts_target > now),
forecasts AS (SELECT * FROM op WHERE i <= {LATEST} AND (focus IS NULL OR focus = signal) QUALIFY row_number() OVER (PARTITION BY ask, signal, horizon ORDER BY (arm = 'ewma') DESC, ts DESC, arm) = 1)"""


def _open(spark, sf_dir):
    from tidegauge.operators.baselines import ARMS

    pairs = F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("predicted")) for a in ARMS]))
    return forecasts(spark, sf_dir).select("signal", "ts", "ts_target", F.lit(HORIZON).alias("horizon"), pairs).filter("predicted IS NOT NULL")


@query("evidence_forecasts_at", f"WITH {_BASE_ASKED}, {FORECAST_SQL} SELECT ask, signal, horizon, arm, ts, round(predicted, 6) AS predicted FROM forecasts")
def evidence_forecasts_at(spark, sf_dir):
    found = at.open_forecasts(asks(spark, sf_dir), _open(spark, sf_dir), HORIZON, "ewma", LATEST)
    return rounded(found.select("ask", "signal", "horizon", "arm", "ts", "predicted"), ["predicted"])


ACCURACY_SQL = f"""am AS (SELECT ask, any_value(focus) AS focus, arm, signal, horizon, count(*) AS n, avg(abs_error) AS mae FROM asks JOIN scored ON ts_target BETWEEN now - {DAY} AND now GROUP BY ask, arm, signal, horizon),
accuracy AS (SELECT a.ask, a.arm, a.signal, a.horizon, a.n, a.mae, CASE WHEN r.mae > 0 THEN 1 - a.mae / r.mae END AS skill FROM am a LEFT JOIN am r ON r.ask = a.ask AND r.signal = a.signal AND r.horizon = a.horizon AND r.arm = 'persistence'
  WHERE a.n >= 10 AND (a.focus IS NULL OR a.focus = a.signal))"""


@query("evidence_accuracy_at", f"WITH {_BASE_ASKED}, {ACCURACY_SQL} SELECT ask, arm, signal, horizon, n, round(mae, 9) AS mae, round(skill, 6) + 0.0 AS skill FROM accuracy")
def evidence_accuracy_at(spark, sf_dir):
    return rounded(rounded(at.accuracy(asks(spark, sf_dir), scored(spark, sf_dir), DAY), ["mae"], MEAN_DIGITS), ["skill"])


#: Rows that a look at the regime takes: fewer than a day has, so that the bound is met.
REGIME_ROWS = 20
_RAW_ASKED = f"{RAW_SQL}, {ASKS_SQL}"
REGIME_SQL = f"""rf AS (SELECT k, k * {HOUR} AS ts, k * {HOUR} + {HORIZON} AS ts_target, coalesce(raw, 'unknown') AS regime FROM raws),
rs AS (SELECT *, sum(CASE WHEN regime IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (ORDER BY k) AS spell FROM (SELECT *, lag(regime) OVER (ORDER BY k) AS was FROM rf)),
rb AS (SELECT *, min(ts) OVER (PARTITION BY spell) AS began FROM rs),
rw AS (SELECT ask, now, rb.*, row_number() OVER (PARTITION BY ask ORDER BY ts_target) AS i FROM asks JOIN rb ON ts_target BETWEEN now - {DAY} AND now),
rh AS (SELECT ask, count(*) AS n, min(ts) AS from_ts, max(ts) AS last_ts, arg_max(regime, ts) AS last_regime, arg_max(began, ts) AS began, {', '.join(f"count(*) FILTER (regime = '{x}') AS c_{x}" for x in regime.LABELS)} FROM rw WHERE i <= {REGIME_ROWS} GROUP BY ask),
ro AS (SELECT ask, arg_max(regime, ts) AS open_regime, arg_max(ts_target, ts) AS due FROM asks JOIN rf ON ts <= now GROUP BY ask),
regimes AS (SELECT *, greatest(0.0, now - CASE WHEN regime = last_regime THEN greatest(began, from_ts) ELSE last_ts END) AS since_s FROM
  (SELECT asks.ask, now, focus, intent, question, coalesce(CASE WHEN due > now THEN open_regime END, last_regime, 'unknown') AS regime, rh.* EXCLUDE (ask) FROM asks LEFT JOIN rh ON rh.ask = asks.ask LEFT JOIN ro ON ro.ask = asks.ask))"""


def _regimes(spark, sf_dir, asked, **kw):
    made = raw_regimes(spark, sf_dir).select(F.col("k").alias("id"), (F.col("k") * HOUR).alias("ts"), (F.col("k") * HOUR + HORIZON).alias("ts_target"), F.coalesce("raw", F.lit("unknown")).alias("regime"))
    return at.regimes(asked, made, regime.LABELS, DAY, REGIME_ROWS, **kw)


@query("evidence_regimes_at", f"WITH {_RAW_ASKED}, {REGIME_SQL} SELECT ask, regime, CASE WHEN n IS NOT NULL THEN round(since_s, 3) ELSE 0.0 END AS since_s, {', '.join(f'round(c_{x} / n, 6) AS share_{x}' for x in regime.LABELS)} FROM regimes")
def evidence_regimes_at(spark, sf_dir):
    found = _regimes(spark, sf_dir, asks(spark, sf_dir))
    return found.select("ask", "regime", F.round("since_s", 3).alias("since_s"), *[F.round(F.col("shares")[x], 6).alias(f"share_{x}") for x in regime.LABELS])


HISTORY_SQL = """hm AS (SELECT r.ask, s.actual - s.anchor AS move FROM regimes r JOIN scored s ON s.arm = 'persistence' AND s.signal = r.focus AND s.ts_target BETWEEN r.now - 604800 AND r.now JOIN rf ON rf.k = s.k AND rf.regime = r.regime),
history AS (SELECT ask, count(*) AS n, quantile_cont(move, 0.1) AS p10, quantile_cont(move, 0.5) AS median, quantile_cont(move, 0.9) AS p90 FROM hm GROUP BY ask HAVING count(*) >= 12)"""
#: The regimes' statement, then the forecasts' tables that it does not have.
_ALL_SQL = f"{RAW_SQL}, {BASE.split(GRID + ',', 1)[1].lstrip()}, {ASKS_SQL}, {REGIME_SQL}, {HISTORY_SQL}"


def _history(spark, sf_dir, asked, found):
    regime_of = raw_regimes(spark, sf_dir).select("k", F.coalesce("raw", F.lit("unknown")).alias("regime"))
    past = scored(spark, sf_dir).filter("arm = 'persistence'").join(regime_of, "k").select("signal", "regime", "horizon", "ts_target", "anchor", "actual")
    return at.history(asked.join(found.select("ask", "regime"), "ask"), past, HORIZON)


@query("evidence_history_at", f"WITH {_ALL_SQL} SELECT ask, n, round(p10, 9) + 0.0 AS p10, round(median, 9) + 0.0 AS median, round(p90, 9) + 0.0 AS p90 FROM history")
def evidence_history_at(spark, sf_dir):
    asked = asks(spark, sf_dir)
    return rounded(_history(spark, sf_dir, asked, _regimes(spark, sf_dir, asked)), ["p10", "median", "p90"], MEAN_DIGITS)


EVENTS_SQL = """ev AS (SELECT 'drift' AS kind, seq AS id, ts, signal AS what FROM readings WHERE value > 60 UNION ALL SELECT 'adaptation', seq, ts, CASE WHEN seq % 3 = 0 THEN 'skipped' ELSE 'promoted' END FROM readings WHERE seq % 2 = 0),
ew AS (SELECT ask, ev.*, row_number() OVER (PARTITION BY ask, kind ORDER BY ts DESC, id DESC) AS i FROM asks JOIN ev ON ts BETWEEN now - 21600 AND now),
events AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY ts DESC, kind DESC, id DESC) AS place FROM ew WHERE i <= 20 AND (kind = 'drift' OR what <> 'skipped')) WHERE place <= 12)"""


def _events(spark, sf_dir, asked):
    rows = readings(spark, sf_dir)
    drift = rows.filter("value > 60").select(F.col("seq").alias("id"), "ts", F.col("signal").alias("what"))
    moves = rows.filter("seq % 2 = 0").select(F.col("seq").alias("id"), "ts", F.when(F.col("seq") % 3 == 0, "skipped").otherwise("promoted").alias("what"))
    return at.events(asked, drift, moves)


@query("evidence_events_at", f"WITH {ASKED}, {EVENTS_SQL.replace('events AS', 'newest AS')} SELECT ask, CAST(place AS INTEGER) AS place, kind, id, ts, what FROM newest")
def evidence_events_at(spark, sf_dir):
    return _events(spark, sf_dir, asks(spark, sf_dir))


#: Feedback over the month of the events, rows scanned for it: fewer than it has, so that both bounds are met.
SCANNED, SAID = 12, 5
FEEDBACK_SQL = "feedback AS (SELECT conv_id * 1000 + turn AS id, 1704067200.0 + ((conv_id * 1000 + turn) * 7919) % 2592000 AS ts, ['note', 'label', 'forecast_useful'][turn % 3 + 1] AS kind, text FROM conversations)"
SAID_SQL = rf"""fb AS (SELECT ask, id, kind, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare, row_number() OVER (PARTITION BY ask ORDER BY ts DESC, id DESC) AS i FROM asks JOIN feedback ON ts <= now),
said AS (SELECT ask, row_number() OVER (PARTITION BY ask ORDER BY i) AS place, id, CASE kind WHEN 'label' THEN 'User labels this behaviour: "' ELSE 'User note: "' END || bare || '"' AS line FROM fb WHERE i <= {SCANNED} AND kind <> 'forecast_useful' AND bare <> '' QUALIFY place <= {SAID})"""


def _said(spark, sf_dir, asked):
    key = F.col("conv_id") * 1000 + F.col("turn")
    kinds = F.array(*map(F.lit, ("note", "label", "forecast_useful")))
    rows = table(spark, sf_dir, "conversations").select(key.alias("id"), (F.lit(1704067200.0) + (key * 7919) % 2592000).alias("ts"), kinds[(F.col("turn") % 3).cast("int")].alias("kind"), "text")
    return at.said(asked, rows, SCANNED, SAID)


@query("evidence_said_at", f"WITH {ASKED}, {FEEDBACK_SQL}, {SAID_SQL} SELECT ask, CAST(place AS INTEGER) AS place, id, line FROM said")
def evidence_said_at(spark, sf_dir):
    return _said(spark, sf_dir, asks(spark, sf_dir))


def packed(spark, sf_dir):
    """Every ask with all its evidence; the ticks are read once for all parts."""
    rows = materialised(hourly(spark, sf_dir), "ticks")
    asked = materialised(asks(spark, sf_dir, rows), "asks")
    outcomes = scored(spark, sf_dir)
    found = materialised(_regimes(spark, sf_dir, asked), "regimes")
    parts = {
        "current": at.current(asked, rows, PRIORITY).select("ask", "place", "signal", "value", "age"), "regime": found, "window": at.windows(asked, rows, DAY, GENERAL, alone=("view",)),
        "levels": at.levels(asked, _levelled(rows), DAY, "view", "signup", "error"), "drivers": _drivers(asked.filter(at.wants("drivers")), rows),
        "forecasts": at.open_forecasts(asked.filter(at.wants("forecasts")), _open(spark, sf_dir), HORIZON, "ewma", LATEST).select("ask", "signal", "horizon", "arm", "ts", "predicted"),
        "accuracy": at.accuracy(asked.filter(at.wants("accuracy")), outcomes, DAY), "history": _history(spark, sf_dir, asked.filter(at.wants("history")), found),
        "events": _events(spark, sf_dir, asked.filter(at.wants("events"))), "said": _said(spark, sf_dir, asked)}
    return at.packs(asked, parts, 2 * HOUR)


def _part_sql(name: str, source: str, wanted: str = "true") -> str:
    return f"CASE WHEN c.n > 0 AND {wanted} THEN coalesce((SELECT count(*) FROM {source} x WHERE x.ask = asks.ask), 0) ELSE 0 END AS {name}"


def _intents(part: str) -> str:
    return "intent IN (" + ", ".join(f"'{i}'" for i in (at.DRIVER_INTENTS if part == "drivers" else at.WANTED[part])) + ")"


_WORDS = "(" + _intents("drivers") + "".join(f" OR contains(lower(question), '{w}')" for w in at.DRIVER_WORDS) + ")"
PACK_SQL = f"""{_ALL_SQL}, {CURRENT_SQL}, {WINDOW_SQL}, {LEVEL_SQL}, {DRIVER_SQL}, {FORECAST_SQL}, {ACCURACY_SQL}, {EVENTS_SQL.replace('events AS', 'newest AS')}, {FEEDBACK_SQL}, {SAID_SQL},
c AS (SELECT asks.ask, count(current.ask) AS n, any_value(current.age) AS age FROM asks LEFT JOIN current ON current.ask = asks.ask GROUP BY asks.ask),
pack AS (SELECT asks.*, c.age, {_part_sql('n_current', 'current')}, {_part_sql('n_window', 'windows')}, {_part_sql('n_levels', 'levels', _intents('levels'))}, {_part_sql('n_drivers', 'drivers', _WORDS)},
  {_part_sql('n_forecasts', 'forecasts', _intents('forecasts'))}, {_part_sql('n_accuracy', 'accuracy', _intents('accuracy'))}, {_part_sql('n_history', 'history', _intents('history'))},
  {_part_sql('n_events', 'newest', _intents('events'))}, {_part_sql('n_said', 'said')} FROM asks JOIN c ON c.ask = asks.ask)"""
_COUNTED = ("current", "window", "levels", "drivers", "forecasts", "accuracy", "history", "events", "said")


@query("evidence_packs", f"""WITH {PACK_SQL} SELECT ask, intent, focus, {', '.join(f'CAST(n_{p} AS INTEGER) AS n_{p}' for p in _COUNTED)},
CASE WHEN n_current = 0 THEN 'no_telemetry' ELSE concat_ws(',', CASE WHEN age > {2 * HOUR} THEN 'stale' END, CASE WHEN {_WORDS} AND focus IS NOT NULL AND n_drivers = 0 THEN 'no_drivers' END,
CASE WHEN {_intents('forecasts')} AND n_forecasts = 0 THEN 'no_forecasts' END) END AS notes FROM pack""")
def evidence_packs(spark, sf_dir):
    """How much of each part every ask's pack has, by its intent; the parts' rows are the queries above."""
    return packed(spark, sf_dir).select("ask", "intent", "focus", *[F.size(p).alias(f"n_{p}") for p in _COUNTED], F.array_join("notes", ",").alias("notes"))


#: The numbers of a pack that its answer may say.
SPOKEN = {
    "current": ("value", "age"), "window": ("mean", "low", "high", "change"), "levels": ("per_minute", "minutes_to_20", "minutes_to_10", "minutes_to_0"), "drivers": ("r", "lag_s", "change"),
    "forecasts": ("predicted",), "accuracy": ("mae", "skill"), "history": ("p10", "median", "p90"),
}


@query("language_dataset")
def language_dataset(spark, sf_dir):
    """Questions at many times, the answers that their evidence gives and the numbers behind them, split by time."""
    return at.examples(packed(spark, sf_dir), at.answer(DAY), at.surface(SPOKEN))


__all__ = ["QUERIES", "SQL"]
