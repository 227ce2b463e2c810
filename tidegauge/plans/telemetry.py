"""Queries of the quality, feature, regime and baseline operators over the event table, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.exprs import rounded
from tidegauge.operators import baselines, features, quality, regime, replay, scan
from tidegauge.sources.readings import READINGS_SQL, readings, ticks, ticks_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIGNALS = ("click", "error", "purchase", "signup", "view")
HOUR = 3600.0
#: The declared ranges of the event signals (the data has none).
LO, HI, MAX_RATE = 0.0, 200.0, 0.05
QUARTER = 900.0


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def hourly(spark: SparkSession, sf_dir: str, step: float = HOUR) -> DataFrame:
    return ticks(readings(spark, sf_dir), step)


GRID = ticks_sql(HOUR)
SPARSE = ticks_sql(QUARTER, dense=False)
BUF = "(PARTITION BY signal ORDER BY k ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)"


def _specs(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(s).alias("signal"), F.lit(LO).alias("lo"), F.lit(HI).alias("hi"), F.lit(MAX_RATE).alias("max_rate"), F.lit(2 * QUARTER).alias("max_hold")) for s in SIGNALS]
    return spark.range(1).select(F.inline(F.array(*rows)))


@query("counter_rate", f"""WITH {READINGS_SQL}, r AS (SELECT seq, signal, ts, CASE WHEN seq % 11 <> 0 THEN value END AS value FROM readings),
l AS (SELECT r.*, p.ts AS pts, p.value AS pv FROM r ASOF LEFT JOIN (SELECT * FROM r WHERE value IS NOT NULL) p ON p.signal = r.signal AND p.seq < r.seq)
SELECT seq, signal, round(CASE WHEN ts > pts AND value >= pv THEN (value - pv) / (ts - pts) END, 6) AS rate FROM l""")
def counter_rate(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 11 != 0, F.col("value")))
    return quality.counter_rate(rows).select("seq", "signal", F.round("rate", 6).alias("rate"))


GAPS_SQL = f"""{SPARSE},
t AS (SELECT DISTINCT k, ts FROM grid), g AS (SELECT *, ts - lag(ts) OVER (ORDER BY k) AS gap_s FROM t),
gaps AS (SELECT *, coalesce(gap_s > {3 * QUARTER} OR gap_s < 0, false) AS discontinuity FROM g),
seg AS (SELECT *, CAST(sum(CAST(discontinuity AS BIGINT)) OVER (ORDER BY k) AS BIGINT) AS segment FROM gaps)"""


@query("gap_segments", f"WITH {GAPS_SQL} SELECT k, gap_s, discontinuity, segment FROM seg")
def gap_segments(spark, sf_dir):
    times = ticks(readings(spark, sf_dir), QUARTER, dense=False).select("k", "ts").distinct()
    return quality.gaps(times, QUARTER).select("k", "gap_s", "discontinuity", "segment")


NORMAL_SQL = f"""{GAPS_SQL},
c AS (SELECT g.signal, g.k, g.ts, s.gap_s, s.segment, g.value AS raw, least(greatest(g.value, {LO}), {HI}) AS clipped,
        greatest(coalesce({LO} - g.value, 0), coalesce(g.value - {HI}, 0)) AS over FROM grid g JOIN seg s ON s.k = g.k),
c2 AS (SELECT * REPLACE (CASE WHEN raw IS NULL THEN NULL ELSE clipped END AS clipped) FROM c),
h AS (SELECT *, last_value(clipped IGNORE NULLS) OVER w AS held, last_value(CASE WHEN clipped IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS held_ts FROM c2
      WINDOW w AS (PARTITION BY signal, segment ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, coalesce(ts - held_ts > 0 AND abs(clipped - held) / (ts - held_ts) > {MAX_RATE}, false) AS spike, coalesce(ts - held_ts <= {2 * QUARTER}, false) AS hold FROM h),
normal AS (SELECT k, ts, gap_s, signal, CASE WHEN clipped IS NOT NULL THEN clipped WHEN hold THEN held END AS value,
    CAST(CASE WHEN clipped IS NOT NULL AND spike THEN 2 WHEN clipped IS NOT NULL AND over > 1e-6 THEN 1 WHEN clipped IS NOT NULL THEN 0 WHEN hold THEN 3 ELSE 5 END AS INTEGER) AS quality FROM q)"""


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.normalise(ticks(readings(spark, sf_dir), QUARTER, dense=False), _specs(spark), QUARTER)


@query("normalise", f"WITH {NORMAL_SQL} SELECT k, signal, gap_s, round(value, 6) AS value, quality FROM normal")
def normalise(spark, sf_dir):
    return normal(spark, sf_dir).select("k", "signal", "gap_s", F.round("value", 6).alias("value"), "quality")


for _name, _q in (("normalise_clamp", 1), ("normalise_spike", 2), ("normalise_hold", 3)):
    query(_name, f"WITH {NORMAL_SQL} SELECT k, signal, round(value, 6) AS value FROM normal WHERE quality = {_q}")(
        lambda spark, sf_dir, q=_q: normal(spark, sf_dir).filter(F.col("quality") == q).select("k", "signal", F.round("value", 6).alias("value")))


@query("quality_counts", f"""WITH {NORMAL_SQL} SELECT signal, count(*) AS samples, count(*) FILTER (quality = 0) AS ok, count(*) FILTER (quality = 1) AS clamped,
count(*) FILTER (quality = 2) AS suspect, count(*) FILTER (quality = 3) AS stale, count(*) FILTER (quality = 5) AS missing FROM normal GROUP BY signal""")
def quality_counts(spark, sf_dir):
    return quality.quality_counts(normal(spark, sf_dir))


@query("worst_quality", f"WITH {NORMAL_SQL} SELECT k, max(quality) AS worst_quality, count(*) FILTER (quality <= 2 AND value IS NOT NULL) AS usable FROM normal GROUP BY k")
def worst_quality(spark, sf_dir):
    return quality.worst_quality(normal(spark, sf_dir))


@query("malformed_values", """SELECT event_id, round(CASE WHEN isfinite(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE) END, 6) AS value FROM
(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN 'nan' WHEN 2 THEN 'infinity' ELSE CAST(value AS VARCHAR) END AS x FROM events)""")
def malformed_values(spark, sf_dir):
    from tidegauge.functions.exprs import finite

    n = F.col("seq") % 5
    text = F.when(n == 0, "abc").when(n == 1, "nan").when(n == 2, "infinity").otherwise(F.col("value").cast("string"))
    return readings(spark, sf_dir).select(F.col("seq").alias("event_id"), F.round(finite(text), 6).alias("value"))


@query("scale_signals", f"""WITH {READINGS_SQL} SELECT seq, signal, round(CASE signal WHEN 'error' THEN CASE WHEN value > 0.5 THEN 1.0 ELSE 0.0 END
WHEN 'view' THEN ln(1 + greatest(value, 0)) / 9 WHEN 'click' THEN value / 100 ELSE (value - {LO}) / {HI - LO} END, 6) AS scaled FROM readings""")
def scale_signals(spark, sf_dir):
    kind = F.when(F.col("signal") == "error", "flag").when(F.col("signal") == "view", "rate").otherwise("gauge")
    bound = lambda v: F.when(F.col("signal") != "click", F.lit(v))
    return readings(spark, sf_dir).select("seq", "signal", F.round(features.scaled(F.col("value"), kind, bound(LO), bound(HI)), 6).alias("scaled"))


LAGS = (0.0, HOUR, 3 * HOUR, 12 * HOUR)


def _lag_sql(seconds: float, digits: int = 9) -> str:
    tol = max(1.5 * HOUR, 0.25 * seconds)
    sorted_ = f"list_sort(list_transform(buffer, lambda r: {{'d': abs(r.ts - (ts - {seconds})), 't': r.ts, 'v': r.value}}))"
    return f"""round(coalesce(CASE WHEN ({sorted_})[1].d <= {tol} THEN coalesce(({sorted_})[1].v, list_filter(({sorted_})[1:6], lambda r: r.d <= {2 * tol} AND r.v IS NOT NULL)[1].v) END, fill), {digits}) AS lag_{seconds:g}"""


@query("lag_features", f"""WITH {GRID}, b AS (SELECT *, list({{'ts': ts, 'value': value}}) OVER {BUF} AS buffer, coalesce(avg(value) OVER {BUF}, 0.5) AS fill FROM grid)
SELECT signal, k, {', '.join(_lag_sql(x) for x in LAGS)} FROM b""")
def lag_features(spark, sf_dir):
    rows = features.with_lags(hourly(spark, sf_dir), LAGS, HOUR)
    names = [f"lag_{x:g}" for x in LAGS]
    return rounded(rows.select("signal", "k", *names), names, 9)


SPAN = 6 * HOUR
SPAN_W = f"(PARTITION BY signal ORDER BY ts RANGE BETWEEN {SPAN} PRECEDING AND CURRENT ROW)"


@query("span_mean_std", f"""WITH {GRID} SELECT signal, k, round(coalesce(avg(value) OVER {SPAN_W}, avg(value) OVER {BUF}, 0.5), 9) AS span_mean,
round(coalesce(stddev_pop(value) OVER {SPAN_W}, 0), 9) AS span_std FROM grid""")
def span_mean_std(spark, sf_dir):
    return rounded(features.span_stats(hourly(spark, sf_dir), SPAN).select("signal", "k", "span_mean", "span_std"), ["span_mean", "span_std"], 9)


@query("span_slope", f"""WITH {GRID} SELECT signal, k, round(CASE WHEN count(value) OVER {SPAN_W} >= 2 THEN coalesce(regr_slope(value, ts) OVER {SPAN_W}, 0) ELSE 0 END * 60, 9) AS span_slope FROM grid""")
def span_slope(spark, sf_dir):
    return rounded(features.span_stats(hourly(spark, sf_dir), SPAN).select("signal", "k", "span_slope"), ["span_slope"], 9)


@query("coverage", f"""WITH {GRID} SELECT signal, k, round(count(value) OVER {BUF} / count(*) OVER {BUF} * least(1, (max(ts) OVER {BUF} - min(ts) OVER {BUF}) / {60 * HOUR}), 6) AS coverage FROM grid""")
def coverage(spark, sf_dir):
    return rounded(features.coverage(hourly(spark, sf_dir), 60 * HOUR).select("signal", "k", "coverage"), ["coverage"])


@query("readiness", f"WITH {GRID} SELECT signal, k, count(*) OVER {BUF} >= 3 AND max(ts) OVER {BUF} - min(ts) OVER {BUF} >= {30 * HOUR} AS ready FROM grid")
def readiness(spark, sf_dir):
    return features.ready(hourly(spark, sf_dir), 30 * HOUR).select("signal", "k", "ready")


@query("time_features", f"""WITH {READINGS_SQL}, t AS (SELECT seq, (ts - floor(ts / 86400) * 86400) / 86400 AS d, (CAST(floor(ts / 86400) AS BIGINT) + 3) % 7 AS w FROM readings)
SELECT seq, round(sin(2 * pi() * d), 6) + 0.0 AS sin_day, round(cos(2 * pi() * d), 6) + 0.0 AS cos_day, round(sin(2 * pi() * (w + d) / 7), 6) + 0.0 AS sin_week, round(cos(2 * pi() * (w + d) / 7), 6) + 0.0 AS cos_week,
CASE WHEN w >= 5 THEN 1.0 ELSE 0.0 END AS weekend FROM t""".replace("CASE WHEN w >= 5 THEN 1.0 ELSE 0.0 END", "CAST(w >= 5 AS DOUBLE)"))
def time_features(spark, sf_dir):
    rows = readings(spark, sf_dir).select("seq", *features.time_features("ts"))
    return rounded(rows, ["sin_day", "cos_day", "sin_week", "cos_week"])


@query("volatility", f"WITH {GRID} SELECT signal, k, round(greatest(CASE WHEN count(value) OVER {SPAN_W} >= 3 THEN stddev_pop(value) OVER {SPAN_W} ELSE 0 END, 1.0), 6) AS volatility FROM grid")
def volatility(spark, sf_dir):
    return rounded(features.volatility(hourly(spark, sf_dir), SPAN, 1.0).select("signal", "k", "volatility"), ["volatility"])


@query("feature_delta", f"""WITH {GRID}, b AS (SELECT *, list({{'ts': ts, 'value': value}}) OVER {BUF} AS buffer, coalesce(avg(value) OVER {BUF}, 0.5) AS fill FROM grid),
l AS (SELECT signal, k, {_lag_sql(0.0, 14)}, {_lag_sql(LAGS[-1], 14)} FROM b) SELECT signal, k, round(lag_0 - lag_{LAGS[-1]:g}, 9) + 0.0 AS delta FROM l""")
def feature_delta(spark, sf_dir):
    return rounded(features.with_delta(hourly(spark, sf_dir), LAGS, HOUR).select("signal", "k", "delta"), ["delta"], 9)


@query("feature_vector", f"""WITH {GRID}, f AS (SELECT *, coalesce(avg(value) OVER {BUF}, 0.5) AS fill, avg(value) OVER {SPAN_W} AS m, stddev_pop(value) OVER {SPAN_W} AS s, last_value(value IGNORE NULLS) OVER {BUF} AS a FROM grid)
SELECT signal, k, [1.0, round(coalesce(value, fill), 9), round(coalesce(m, fill), 9), round(coalesce(s, 0), 9), round(coalesce(a, 0), 9)]::DOUBLE[] AS vec FROM f""")
def feature_vector(spark, sf_dir):
    rows = features.summary(hourly(spark, sf_dir), SPAN)
    vec = F.array(F.lit(1.0), F.round(F.coalesce("value", "fill"), 9), F.round("span_mean", 9), F.round("span_std", 9), F.round(F.coalesce("anchor", F.lit(0.0)), 9))
    return rows.select("signal", "k", vec.alias("vec"))


# -- regimes ------------------------------------------------------------------------------------------------------------

WIDE_SQL = f"""{GRID}, wide AS (SELECT k, max(value) FILTER (signal = 'click') AS click, max(value) FILTER (signal = 'error') AS error, max(value) FILTER (signal = 'purchase') AS purchase,
max(value) FILTER (signal = 'signup') AS signup, max(value) FILTER (signal = 'view') AS view FROM grid GROUP BY k)"""
RAW_SQL = f"""{WIDE_SQL}, raws AS (SELECT k, CASE WHEN click IS NULL THEN 'unknown' WHEN coalesce(signup / 100 > 0.5, false) THEN 'charging' WHEN coalesce(view / 100 < 0.5 AND purchase <= 25, false) THEN 'battery_constrained'
WHEN coalesce(click > 35 AND (error / greatest(click, 1e-6) >= 0.30 OR (error >= view * 0.8 AND error > 35)), false) THEN 'build' WHEN coalesce(purchase >= 25 AND purchase > click, false) THEN 'gpu_heavy'
WHEN coalesce(view >= 40 AND click < 65, false) THEN 'io_heavy' WHEN click >= 65 THEN 'compute_heavy' WHEN click <= 8 THEN 'idle' ELSE 'interactive' END AS raw FROM wide)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.operators.store import pivot_window

    return pivot_window(hourly(spark, sf_dir), SIGNALS)


def raw_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    label = regime.raw_label(c("click"), c("purchase"), c("view") / 100, c("signup") / 100, c("error"), c("view"), c("purchase"), c("view"))
    return wide(spark, sf_dir).select("k", label.alias("raw"))


@query("regime_raw", f"WITH {RAW_SQL} SELECT k, raw FROM raws")
def regime_raw(spark, sf_dir):
    return raw_regimes(spark, sf_dir)


@query("regime_one_hot", f"WITH {RAW_SQL} SELECT k, " + ", ".join(f"CASE WHEN raw = '{x}' THEN 1.0 ELSE 0.0 END::DOUBLE AS regime_{x}" for x in regime.LABELS) + " FROM raws")
def regime_one_hot(spark, sf_dir):
    return raw_regimes(spark, sf_dir).select("k", *regime.one_hot("raw"))


VECTOR_LAGS, VECTOR_SPANS = (0.0, 3 * HOUR), (SPAN,)
VECTOR_NAMES = features.vector_names(SIGNALS, VECTOR_LAGS, VECTOR_SPANS, regime.LABELS)


@query("feature_vector_all", f"""WITH {RAW_SQL}, b AS (SELECT *, list({{'ts': ts, 'value': value}}) OVER {BUF} AS buffer, coalesce(avg(value) OVER {BUF}, 0.5) AS fill,
  avg(value) OVER {SPAN_W} AS m, stddev_pop(value) OVER {SPAN_W} AS s, CASE WHEN count(value) OVER {SPAN_W} >= 2 THEN regr_slope(value, ts) OVER {SPAN_W} END AS g,
  count(value) OVER {BUF} AS held, count(*) OVER {BUF} AS slots, max(ts) OVER {BUF} - min(ts) OVER {BUF} AS reach FROM grid),
l AS (SELECT *, {_lag_sql(0.0, 14)}, {_lag_sql(3 * HOUR, 14)} FROM b),
p AS (SELECT k, list([round(lag_0, 9), round(lag_10800, 9), round(coalesce(m, fill), 9), round(coalesce(s, 0), 9), round(coalesce(g, 0) * 60, 9), round(lag_0 - lag_10800, 9)] ORDER BY signal) AS parts,
  sum(held) / sum(slots) * least(1.0, max(reach) / {64 * HOUR}) AS coverage, any_value(ts) AS ts FROM l GROUP BY k),
t AS (SELECT p.*, raw, (ts % 86400) / 86400 AS d, (floor(ts / 86400) + 3) % 7 AS wd FROM p JOIN raws USING (k))
SELECT k, list_transform(flatten([[1.0], flatten(parts), [round(sin(2 * pi() * d), 9), round(cos(2 * pi() * d), 9), round(sin(2 * pi() * (wd + d) / 7), 9), round(cos(2 * pi() * (wd + d) / 7), 9), CASE WHEN wd >= 5 THEN 1 ELSE 0 END],
  [{', '.join(f"CASE WHEN raw = '{x}' THEN 1 ELSE 0 END" for x in regime.LABELS)}], [round(coverage, 9)]]), lambda x: CAST(x AS DOUBLE) + 0.0) AS vec FROM t""")
def feature_vector_all(spark, sf_dir):
    """One vector a tick over all signals, with time, regime and coverage columns."""
    return features.vectors(hourly(spark, sf_dir), SIGNALS, VECTOR_LAGS, VECTOR_SPANS, HOUR, 64 * HOUR, raw_regimes(spark, sf_dir).withColumnRenamed("raw", "regime"), regime.LABELS)


@query("feature_mask", "WITH s AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS signal), f AS (SELECT unnest(['lag_0', 'lag_10800', 'mean_21600', 'std_21600', 'slope_21600', 'delta_10800']) AS feature), "
       "n AS (SELECT t.signal AS target, s.signal || '|' || feature AS name, s.signal = t.signal OR feature IN ('lag_0', 'mean_21600', 'slope_21600') AS kept FROM s, f, s t UNION ALL "
       "SELECT signal, unnest(['bias', 'time|sin_day', 'time|cos_day', 'time|sin_week', 'time|cos_week', 'time|weekend', 'meta|coverage', " + ", ".join(f"'regime|{x}'" for x in regime.LABELS) + "]), true FROM s) SELECT target, name, kept FROM n")
def feature_mask(spark, sf_dir):
    rows = [F.struct(F.lit(t).alias("target"), F.lit(n).alias("name"), F.lit(bool(k)).alias("kept")) for t in SIGNALS for n, k in zip(VECTOR_NAMES, features.mask(VECTOR_NAMES, t, VECTOR_SPANS), strict=True)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def settled_sql(run: str) -> str:
    """The hysteresis of the raw labels, run by run; the statement needs WITH RECURSIVE, as each round takes one tick of every run."""
    return f"""{RAW_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) AS n FROM (SELECT *, {run} AS run FROM raws)),
settled AS (SELECT run, n, k, raw, raw AS regime, 1 AS streak FROM placed WHERE n = 1
UNION ALL SELECT run, n, k, raw, CASE WHEN open OR same >= 3 THEN raw ELSE regime END, CASE WHEN open THEN 1 WHEN raw = regime OR same >= 3 THEN 0 ELSE same END
FROM (SELECT p.run, p.n, p.k, p.raw, s.regime, s.regime = 'unknown' AND s.streak = 0 AS open, CASE WHEN p.raw = s.regime THEN 0 WHEN p.raw = s.raw THEN s.streak + 1 ELSE 1 END AS same
FROM settled s JOIN placed p ON p.run = s.run AND p.n = s.n + 1))"""


SETTLED_SQL = settled_sql("'all'")


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, k, raw, regime) of every tick, those without a label too; all ticks are one run."""
    return scan.settled(raw_regimes(spark, sf_dir).withColumn("run", F.lit("all")))


#: Ticks of a block in ``regime_hysteresis``: few, so that the small tables have several blocks too.
TICKS_A_BLOCK = 256


@query("regime_hysteresis", f"WITH RECURSIVE {SETTLED_SQL} SELECT k, raw, regime FROM settled")
def regime_hysteresis(spark, sf_dir):
    return scan.settled(raw_regimes(spark, sf_dir).withColumn("run", F.lit("all")), block_rows=TICKS_A_BLOCK).select("k", "raw", "regime")


@query("regime_hysteresis_keyed", f"WITH RECURSIVE {settled_sql('CAST(k // 168 AS VARCHAR)')} SELECT run, k, raw, regime FROM settled")
def regime_hysteresis_keyed(spark, sf_dir):
    """Each week as a run of its own."""
    return replay.settled(raw_regimes(spark, sf_dir).withColumn("run", F.floor(F.col("k") / 168).cast("string")))


_LABELS = ("charging", "gpu_heavy", "io_heavy", "interactive")


@query("regime_shares", f"WITH RECURSIVE {SETTLED_SQL} SELECT k, " + ", ".join(
    f"round(sum(CASE WHEN regime = '{x}' THEN 1.0 ELSE 0.0 END) OVER w / count(*) OVER w, 6)::DOUBLE AS share_{x}" for x in _LABELS) + " FROM settled WINDOW w AS (ORDER BY k ROWS BETWEEN 255 PRECEDING AND CURRENT ROW)")
def regime_shares(spark, sf_dir):
    names = [f"share_{x}" for x in _LABELS]
    return rounded(regime.shares(settled(spark, sf_dir), _LABELS).select("k", *names), names)


@query("regime_spells", f"""WITH RECURSIVE {SETTLED_SQL}, s AS (SELECT *, sum(fresh) OVER (ORDER BY k) AS spell FROM (SELECT *, CASE WHEN regime = lag(regime) OVER (ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM settled))
SELECT regime, min(k) AS since, max(k) AS until, count(*) AS ticks FROM s GROUP BY spell, regime""")
def regime_spells(spark, sf_dir):
    from tidegauge.operators.evidence import regime_spells as spells

    return spells(settled(spark, sf_dir))


# -- baselines and resolution --------------------------------------------------------------------------------------------

HORIZON = 3 * HOUR
WINDOW, HALF_LIFE = 6 * HOUR, 3 * HOUR
CLIP = lambda x: f"least(greatest({x}, {LO}), {HI})"


def base_sql(step: float = HOUR, horizon: float = HORIZON, window: float = WINDOW, half_life: float = HALF_LIFE) -> str:
    """DuckDB form of ``baselines.forecasts`` and ``resolve``: CTEs base and resolved."""
    import math

    recent = f"(PARTITION BY signal ORDER BY ts RANGE BETWEEN {window} PRECEDING AND CURRENT ROW)"
    tol = max(1.5 * step, 2.0)
    weight = f"exp(-{math.log(2.0) / half_life} * (ts - r.ts))"
    return f"""{ticks_sql(step)},
b0 AS (SELECT *, last_value(value IGNORE NULLS) OVER {BUF} AS anchor, count(value) OVER {BUF} AS n, avg(value) OVER {recent} AS ma, count(value) OVER {recent} AS nr,
  CASE WHEN count(value) OVER {recent} >= 3 THEN regr_slope(value, ts) OVER {recent} WHEN count(value) OVER {BUF} >= 2 THEN regr_slope(value, ts) OVER {BUF} END AS trend,
  list({{'ts': ts, 'value': value}}) OVER {BUF} AS buffer FROM grid),
b1 AS (SELECT *, list_filter(buffer, lambda r: r.value IS NOT NULL) AS held FROM b0),
base AS (SELECT signal, k, ts, value, anchor, ts + {horizon} AS ts_target, anchor AS persistence,
  CASE WHEN coalesce(ma, anchor) IS NOT NULL THEN {CLIP('coalesce(ma, anchor)')} END AS moving_average,
  CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN anchor ELSE {CLIP(f'list_sum(list_transform(held, lambda r: {weight} * r.value)) / list_sum(list_transform(held, lambda r: {weight}))')} END AS ewma,
  CASE WHEN n = 0 THEN NULL WHEN n < 3 OR trend IS NULL THEN anchor ELSE {CLIP(f'anchor + trend * {horizon}')} END AS linear_trend FROM b1),
near AS (SELECT b.signal, b.k, g.ts AS t, g.value AS v, b.ts_target FROM base b JOIN grid g ON g.signal = b.signal AND g.ts BETWEEN b.ts_target - {tol} AND b.ts_target + {tol}),
pick AS (SELECT signal, k, any_value(ts_target) AS target, max(t) FILTER (v IS NOT NULL AND t < ts_target) AS tb, arg_max(v, t) FILTER (v IS NOT NULL AND t < ts_target) AS vb,
  min(t) FILTER (t >= ts_target) AS t1, arg_min({{'v': v}}, t) FILTER (t >= ts_target) AS f1, min(t) FILTER (v IS NOT NULL AND t >= ts_target) AS ta, arg_min(v, t) FILTER (v IS NOT NULL AND t >= ts_target) AS va FROM near GROUP BY signal, k),
resolved AS (SELECT b.*, CASE WHEN t1 IS NULL THEN NULL WHEN f1.v IS NOT NULL AND (tb IS NULL OR abs(t1 - target) <= abs(tb - target)) THEN f1.v WHEN tb IS NOT NULL THEN vb ELSE va END AS actual,
  CASE WHEN t1 IS NULL THEN NULL WHEN f1.v IS NOT NULL OR tb IS NOT NULL THEN t1 ELSE ta END AS resolved_ts FROM base b LEFT JOIN pick p ON p.signal = b.signal AND p.k = b.k),
scored AS (SELECT r.*, a.arm, a.predicted, a.predicted - r.actual AS error, abs(a.predicted - r.actual) AS abs_error, CAST({horizon} AS DOUBLE) AS horizon FROM resolved r,
  LATERAL (VALUES ('persistence', r.persistence), ('moving_average', r.moving_average), ('ewma', r.ewma), ('linear_trend', r.linear_trend)) a(arm, predicted)
  WHERE r.actual IS NOT NULL AND a.predicted IS NOT NULL)"""


BASE = base_sql()


def forecasts(spark: SparkSession, sf_dir: str, step: float = HOUR, horizon: float = HORIZON, window: float = WINDOW, half_life: float = HALF_LIFE) -> DataFrame:
    return baselines.forecasts(hourly(spark, sf_dir, step), horizon, window, half_life, LO, HI)


def resolved(spark: SparkSession, sf_dir: str, step: float = HOUR, **kw) -> DataFrame:
    grid = hourly(spark, sf_dir, step)
    return baselines.resolve(forecasts(spark, sf_dir, step, **kw), grid, step)


def scored(spark: SparkSession, sf_dir: str, step: float = HOUR, horizon: float = HORIZON, **kw) -> DataFrame:
    return baselines.scored(resolved(spark, sf_dir, step, horizon=horizon, **kw)).withColumn("horizon", F.lit(float(horizon)))


for _name, _arm in (("baseline_persistence", "persistence"), ("baseline_moving_average", "moving_average"), ("baseline_ewma", "ewma"), ("baseline_linear_trend", "linear_trend")):
    query(_name, f"WITH {BASE} SELECT signal, k, round({_arm}, 6) AS predicted FROM base")(
        lambda spark, sf_dir, arm=_arm: forecasts(spark, sf_dir).select("signal", "k", F.round(arm, 6).alias("predicted")))


@query("baseline_seasonal_naive", f"""WITH {GRID} SELECT g.signal, g.k, round(p.value, 6) AS predicted FROM grid g LEFT JOIN grid p ON p.signal = g.signal AND p.ts = g.ts + {HORIZON} - 86400""")
def baseline_seasonal_naive(spark, sf_dir):
    return baselines.seasonal_naive(hourly(spark, sf_dir), HORIZON).select("signal", "k", F.round("seasonal_naive", 6).alias("predicted"))


@query("resolve_asof", f"WITH {BASE} SELECT signal, k, round(actual, 6) AS actual, resolved_ts FROM resolved")
def resolve_asof(spark, sf_dir):
    return resolved(spark, sf_dir).select("signal", "k", F.round("actual", 6).alias("actual"), "resolved_ts")


@query("error_fields", f"WITH {BASE} SELECT signal, k, arm, round(error, 6) + 0.0 AS error, round(abs_error, 6) AS abs_error, actual BETWEEN predicted - 10 AND predicted + 10 AS in_interval FROM scored")
def error_fields(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.select("signal", "k", "arm", (F.round("error", 6) + F.lit(0.0)).alias("error"), F.round("abs_error", 6).alias("abs_error"), F.col("actual").between(F.col("predicted") - 10, F.col("predicted") + 10).alias("in_interval"))


EXAMPLES_SQL = f"""{BASE}, ex AS (SELECT *, greatest(CASE WHEN count(value) OVER {SPAN_W} >= 3 THEN stddev_pop(value) OVER {SPAN_W} ELSE 0 END, 1.0) AS vol FROM resolved),
examples AS (SELECT signal, k, ts, ts_target, anchor, actual, vol, least(greatest((actual - anchor) / vol, -8), 8) AS y, coalesce(least(greatest((moving_average - anchor) / vol, -8), 8), 0) AS x_ma,
coalesce(least(greatest((ewma - anchor) / vol, -8), 8), 0) AS x_ewma, coalesce(least(greatest((linear_trend - anchor) / vol, -8), 8), 0) AS x_trend, persistence, moving_average, ewma, linear_trend FROM ex WHERE actual IS NOT NULL AND anchor IS NOT NULL)"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples: the target and the baselines' extras in volatilities."""
    from tidegauge.operators.learning import target

    rows = features.volatility(resolved(spark, sf_dir), SPAN, 1.0).withColumnRenamed("volatility", "vol").filter("actual IS NOT NULL AND anchor IS NOT NULL")
    extra = lambda c: baselines.extras(F.col(c), F.col("anchor"), F.col("vol"))
    return rows.withColumns({"y": target(F.col("actual"), F.col("anchor"), F.col("vol")), "x_ma": extra("moving_average"), "x_ewma": extra("ewma"), "x_trend": extra("linear_trend")})


@query("training_examples", f"WITH {EXAMPLES_SQL} SELECT signal, k, round(y, 6) + 0.0 AS y, round(x_ma, 6) + 0.0 AS x_ma, round(x_ewma, 6) + 0.0 AS x_ewma, round(x_trend, 6) + 0.0 AS x_trend FROM examples")
def training_examples(spark, sf_dir):
    names = ["y", "x_ma", "x_ewma", "x_trend"]
    return rounded(examples(spark, sf_dir).select("signal", "k", *names), names)
