"""Queries of the report, learning, store and evidence operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.exprs import rounded
from tidegauge.operators import baselines, evidence, learning, order_stats, reports, store
from tidegauge.plans.telemetry import BASE, EXAMPLES_SQL, GRID, HORIZON, HOUR, QUERIES, SETTLED_SQL, SIGNALS, SQL, WIDE_SQL, base_sql, examples, hourly, query, scored, settled, wide
from tidegauge.sources.readings import READINGS_SQL, readings, table

ARMS = baselines.ARMS
METRICS = ["mae", "rmse", "bias", "p90", "max_abs", "smape"]
SIX = 6 * HOUR
METRIC_SQL = """count(*) AS n, round(avg(abs_error), 6) AS mae, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(error), 6) + 0.0 AS bias, round(quantile_cont(abs_error, 0.9), 6) AS p90,
round(max(abs_error), 6) AS max_abs, round(100 * avg(CASE WHEN (abs(predicted) + abs(actual)) / 2 > 1e-6 THEN abs_error / ((abs(predicted) + abs(actual)) / 2) END), 6) AS smape"""


@query("error_metrics", f"WITH {BASE} SELECT arm, signal, horizon, {METRIC_SQL} FROM scored GROUP BY arm, signal, horizon")
def error_metrics(spark, sf_dir):
    return rounded(reports.metrics(scored(spark, sf_dir), ["arm", "signal", "horizon"]), METRICS)


def skill_report(spark, sf_dir, step: float = SIX):
    """Accuracy and skill against persistence, by arm, signal and horizon, on a grid of ``step`` seconds."""
    rows = scored(spark, sf_dir, step, horizon=2 * step, window=6 * step, half_life=3 * step)
    report = reports.with_skill(reports.metrics(rows, ["arm", *reports.SCOPE]), reports.SCOPE)
    return rounded(report, [*METRICS, "ref_mae", "skill"])


SKILL_BASE = base_sql(SIX, 2 * SIX, 6 * SIX, 3 * SIX)
query("skill_report", f"""WITH {SKILL_BASE}, m AS (SELECT arm, signal, horizon, {METRIC_SQL}, avg(abs_error) AS exact FROM scored GROUP BY arm, signal, horizon),
r AS (SELECT *, max(CASE WHEN arm = 'persistence' THEN exact END) OVER (PARTITION BY signal, horizon) AS ref FROM m)
SELECT * EXCLUDE (exact, ref), round(ref, 6) AS ref_mae, round(CASE WHEN ref > 0 THEN 1 - exact / ref END, 6) + 0.0 AS skill FROM r""")(lambda spark, sf_dir: skill_report(spark, sf_dir))


@query("report_by_regime", f"""WITH RECURSIVE {BASE}, {SETTLED_SQL.split(GRID + ',', 1)[1].lstrip()}
SELECT s.arm, s.signal, s.horizon, CASE WHEN grouping(g.regime) = 1 THEN 'all' ELSE g.regime END AS regime, count(*) AS n, round(avg(abs_error), 6) AS mae FROM scored s JOIN settled g ON g.k = s.k
GROUP BY GROUPING SETS ((arm, signal, horizon, regime), (arm, signal, horizon))""")
def report_by_regime(spark, sf_dir):
    rows = scored(spark, sf_dir).join(settled(spark, sf_dir).select("k", "regime"), "k")
    key = [F.col("arm"), F.col("signal"), F.col("horizon"), F.col("regime")]
    grouped = rows.groupingSets([key, key[:3]], *key).agg(F.grouping("regime").alias("_g"), F.count("*").alias("n"), F.round(F.avg("abs_error"), 6).alias("mae"))
    return grouped.select("arm", "signal", "horizon", F.when(F.col("_g") == 1, "all").otherwise(F.col("regime")).alias("regime"), "n", "mae")


@query("report_over_time", f"""WITH {BASE}, w AS (SELECT *, min(ts_target) OVER p AS lo, (max(ts_target) OVER p + 1e-6 - min(ts_target) OVER p) / 4 AS step FROM scored WINDOW p AS (PARTITION BY signal, horizon)),
g AS (SELECT signal, horizon, arm, CAST(least(floor((ts_target - lo) / step), 3) AS INTEGER) AS part, count(*) AS n, round(avg(abs_error), 6) AS mae FROM w GROUP BY ALL)
SELECT * EXCLUDE (total) FROM (SELECT *, sum(n) OVER (PARTITION BY signal, horizon, part) AS total FROM g) WHERE total >= 20""")
def report_over_time(spark, sf_dir):
    return rounded(reports.over_time(scored(spark, sf_dir), 4), ["mae"])


@query("best_arm_table", f"""WITH {BASE}, m AS (SELECT arm, signal, horizon, count(*) AS n, avg(abs_error) AS mae FROM scored GROUP BY ALL)
SELECT signal, horizon, {', '.join(f"round(max(mae) FILTER (arm = '{a}'), 6) AS {a}" for a in ARMS)}, arg_min(arm, mae) AS best_arm, min(n) AS n_min, max(n) AS n_max, max(n) > 2 * min(n) AS uneven FROM m GROUP BY signal, horizon""")
def best_arm_table(spark, sf_dir):
    report = reports.metrics(scored(spark, sf_dir), ["arm", *reports.SCOPE])
    return rounded(reports.comparison(report, ARMS), ARMS)


@query("arm_wins", f"""WITH {BASE}, m AS (SELECT signal, horizon, avg(abs_error) FILTER (arm = 'ewma') AS a, avg(abs_error) FILTER (arm = 'persistence') AS b FROM scored GROUP BY ALL)
SELECT count(*) AS scopes, count(*) FILTER (1 - a / b > 0.01) AS better, count(*) FILTER (1 - a / b < -0.01) AS worse FROM m""")
def arm_wins(spark, sf_dir):
    return reports.arm_wins(reports.metrics(scored(spark, sf_dir), ["arm", *reports.SCOPE]), "ewma", "persistence")


@query("dm_test", f"""WITH {BASE}, p AS (SELECT signal, horizon, ts_target, max(abs_error) FILTER (arm = 'ewma') - max(abs_error) FILTER (arm = 'persistence') AS d FROM scored GROUP BY ALL),
c AS (SELECT signal, horizon, d - avg(d) OVER w AS c, row_number() OVER (PARTITION BY signal, horizon ORDER BY ts_target) AS i, count(*) OVER w AS n, avg(d) OVER w AS m FROM p WHERE d IS NOT NULL WINDOW w AS (PARTITION BY signal, horizon)),
l AS (SELECT signal, horizon, k, 1 - k / (greatest(1, floor(power(any_value(a.n), 1 / 3.0))) + 1.0) AS weight, avg(a.c * b.c) AS gamma
      FROM c a JOIN c b USING (signal, horizon) JOIN (SELECT unnest(range(1, 1000)) AS k) g ON b.i = a.i + g.k WHERE g.k <= greatest(1, floor(power(a.n, 1 / 3.0))) GROUP BY signal, horizon, k),
s AS (SELECT signal, horizon, count(*) AS n, any_value(m) AS m, avg(c * c) AS g0 FROM c GROUP BY ALL),
f AS (SELECT s.*, g0 + coalesce((SELECT sum(2 * weight * gamma) FROM l WHERE l.signal = s.signal AND l.horizon = s.horizon), 0) AS var FROM s),
z AS (SELECT *, CASE WHEN n >= 30 AND var > 0 THEN m / sqrt(var / n) END AS stat, abs(stat) / sqrt(2.0) AS x FROM f)
SELECT signal, horizon, n, round(m, 6) + 0.0 AS mean_difference, round(stat, 6) + 0.0 AS statistic,
round(CASE WHEN x > 4 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda i: power(-1.0, i) * power(x, 2 * i + 1) / (gamma(i + 1) * (2 * i + 1)))) END, 4) + 0.0 AS p_value FROM z""")
def dm_test(spark, sf_dir):
    """The p value to four digits: the statement sums the series of the error function, the operator fits its complement."""
    return rounded(rounded(reports.diebold_mariano(scored(spark, sf_dir), "ewma", "persistence"), ["mean_difference", "statistic"]), ["p_value"], 4)


#: Values of a group, and bins of a round, in ``exact_quantiles`` and ``reservoir_sample``: few, so that groups of the small tables are refined too.
QUERY_FEW, QUERY_BINS = 500, 256


@query("exact_quantiles", """SELECT event_type AS signal, user_id % 3 AS part, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90,
round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY ALL""")
def exact_quantiles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("signal"), (F.col("user_id") % 3).alias("part"), "value")
    found = order_stats.quantiles(rows, ["signal", "part"], "value", [0.1, 0.5, 0.9, 0.999], QUERY_FEW, QUERY_BINS)
    return found.select("signal", "part", "n", *[F.round(F.col("quantiles")[i], 6).alias(c) for i, c in enumerate(("p10", "median", "p90", "p999"))])


@query("reservoir_sample", """WITH p AS (SELECT event_type AS signal, event_id, ('0x' || substr(md5('1337:' || event_id), 1, 13))::BIGINT AS priority FROM events)
SELECT signal, event_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY priority) AS i FROM p) WHERE i <= 120""")
def reservoir_sample(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("signal"), "event_id")
    return order_stats.reservoir(rows, ["signal"], 120, ["event_id"], 1337, QUERY_FEW, QUERY_BINS).select("signal", "event_id", F.col("_priority").alias("priority"))


WIDTH_SQL = f"""{BASE}, e AS (SELECT *, list(abs_error) OVER (PARTITION BY signal, horizon ORDER BY ts_target ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS pool FROM scored WHERE arm = 'persistence'),
widths AS (SELECT *, CASE WHEN len(pool) >= 30 THEN list_aggregate(pool, 'quantile_cont', 0.9) END AS width FROM e)"""


def widths(spark, sf_dir):
    """Persistence forecasts with a fixed-share rolling interval."""
    return reports.rolling_quantile(scored(spark, sf_dir).filter("arm = 'persistence'"), 0.9, 200, 30)


@query("rolling_quantile_interval", f"WITH {WIDTH_SQL} SELECT signal, k, round(width, 6) AS width FROM widths")
def rolling_quantile_interval(spark, sf_dir):
    return widths(spark, sf_dir).select("signal", "k", F.round("width", 6).alias("width"))


def bounded(spark, sf_dir):
    return widths(spark, sf_dir).withColumns({"lo": F.col("predicted") - F.col("width"), "hi": F.col("predicted") + F.col("width")})


@query("interval_coverage", f"""WITH {WIDTH_SQL} SELECT signal, count(*) AS n, round(avg(CASE WHEN actual >= predicted - width AND actual <= predicted + width THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS coverage,
round(avg(2 * width), 6) AS mean_width FROM widths WHERE width IS NOT NULL GROUP BY signal""")
def interval_coverage(spark, sf_dir):
    return rounded(reports.interval_quality(bounded(spark, sf_dir), ["signal"]), ["coverage", "mean_width"])


CURVE_SQL = f"""{WIDTH_SQL}, b AS (SELECT signal, predicted - width AS lo, predicted + width AS hi, actual, round((predicted + width) - (predicted - width), 9) AS wd FROM widths WHERE width IS NOT NULL),
e2 AS (SELECT signal, count(*) AS n, quantile_cont(wd, [0.2, 0.4, 0.6, 0.8]) AS edges FROM b GROUP BY signal)"""


@query("calibration_curve", f"""WITH {CURVE_SQL} SELECT b.signal, CAST(list_sum(list_transform(edges, lambda e: CAST(wd >= e AS INTEGER))) AS INTEGER) AS bin, count(*) AS n, round(avg(wd), 6) AS mean_width,
round(avg(CASE WHEN actual >= lo AND actual <= hi THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS coverage FROM b JOIN e2 ON e2.signal = b.signal WHERE e2.n >= 20 GROUP BY 1, 2""")
def calibration_curve(spark, sf_dir):
    return rounded(reports.calibration_curve(bounded(spark, sf_dir)), ["mean_width", "coverage"])


@query("chronological_split", f"""WITH {GRID}, p AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY signal) AS n FROM grid WINDOW w AS (PARTITION BY signal ORDER BY ts)),
q AS (SELECT *, CASE WHEN i < floor(n * 0.6 + 1e-9) THEN 'train' WHEN i < floor(n * 0.8 + 1e-9) THEN 'validation' ELSE 'test' END AS part FROM p),
s AS (SELECT *, min(ts) FILTER (part = 'validation') OVER (PARTITION BY signal) AS v, min(ts) FILTER (part = 'test') OVER (PARTITION BY signal) AS t FROM q)
SELECT signal, k, part FROM s WHERE NOT coalesce((part = 'train' AND ts >= v - {HORIZON}) OR (part = 'validation' AND ts >= t - {HORIZON}), false)""")
def chronological_split(spark, sf_dir):
    return reports.chronological_split(hourly(spark, sf_dir), HORIZON).select("signal", "k", "part")


@query("rolling_origin", f"""WITH {GRID}, p AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY signal) AS n FROM grid),
f AS (SELECT p.*, f.fold, floor(n * 0.4 + 1e-9) + f.fold * floor((n - floor(n * 0.4 + 1e-9)) / 4) AS first, floor((n - floor(n * 0.4 + 1e-9)) / 4) AS width FROM p CROSS JOIN (SELECT unnest(range(4)) AS fold) f),
o AS (SELECT *, min(ts) FILTER (i >= first AND i < first + width) OVER (PARTITION BY signal, fold) AS opening FROM f),
m AS (SELECT *, CASE WHEN i >= first AND i < first + width THEN 'test' WHEN i < first AND ts < opening - {HORIZON} THEN 'train' END AS part FROM o)
SELECT signal, CAST(fold AS INTEGER) AS fold, part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM m WHERE part IS NOT NULL GROUP BY signal, fold, part""")
def rolling_origin(spark, sf_dir):
    return reports.rolling_origin(hourly(spark, sf_dir), 4, HORIZON)


# -- learning ------------------------------------------------------------------------------------------------------------


@query("standardiser_warmup", f"""WITH {EXAMPLES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY k) AS i FROM examples),
s AS (SELECT signal, avg(x_ma) AS m, greatest(stddev_pop(x_ma), 0.02) AS sd FROM p WHERE i <= 120 GROUP BY signal)
SELECT p.signal, p.k, round(least(greatest((p.x_ma - s.m) / s.sd, -5), 5), 6) + 0.0 AS x_ma FROM p JOIN s ON s.signal = p.signal""")
def standardiser_warmup(spark, sf_dir):
    return rounded(learning.warmed_up(examples(spark, sf_dir), ["x_ma"], 120).select("signal", "k", "x_ma"), ["x_ma"])


_X = ["one", "x_ma", "x_ewma", "x_trend"]
_PAIRS = [(i, j) for i in range(4) for j in range(i, 5)]


@query("ridge_gram", f"""WITH {EXAMPLES_SQL}, x AS (SELECT signal, [1.0, x_ma, x_ewma, x_trend, y] AS v FROM examples), c AS (SELECT * FROM (VALUES {', '.join(f'({i}, {j})' for i, j in _PAIRS)}) t(i, j))
SELECT signal, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(v[i + 1] * v[j + 1]), 4) + 0.0 AS value FROM x CROSS JOIN c GROUP BY signal, i, j""")
def ridge_gram(spark, sf_dir):
    return rounded(learning.gram(examples(spark, sf_dir).withColumn("one", F.lit(1.0)), _X, "y"), ["value"], 4)


GATE_SQL = f"""{EXAMPLES_SQL}, g0 AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY ts_target DESC, k DESC) AS i FROM examples),
gate AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY signal) > 120 AND i <= 120 THEN 'gate' ELSE 'train' END AS part FROM g0 WHERE i <= 600)"""


@query("gate_split", f"WITH {GATE_SQL} SELECT signal, k, part FROM gate")
def gate_split(spark, sf_dir):
    return learning.gate_split(examples(spark, sf_dir), 120).select("signal", "k", "part")


@query("baseline_floor", f"""WITH {GATE_SQL}, m AS (SELECT signal, a.arm, avg(abs(a.p - actual)) AS mae FROM gate, LATERAL (VALUES ('persistence', persistence), ('moving_average', moving_average), ('ewma', ewma), ('linear_trend', linear_trend)) a(arm, p)
WHERE part = 'gate' AND a.p IS NOT NULL GROUP BY signal, a.arm) SELECT signal, arg_min(arm, mae) AS best_baseline, round(min(mae), 6) AS floor_mae FROM m GROUP BY signal""")
def baseline_floor(spark, sf_dir):
    gate = learning.gate_split(examples(spark, sf_dir), 120).filter("part = 'gate'")
    return rounded(learning.baseline_floor(gate, ARMS), ["floor_mae"])


@query("gate_decision", f"""WITH {GATE_SQL}, m AS (SELECT signal, avg(abs(ewma - actual)) AS c, avg(abs(persistence - actual)) AS l FROM gate WHERE part = 'gate' GROUP BY signal)
SELECT signal, CASE WHEN c > l * 1.15 THEN 'hard_reject_worse' WHEN c <= l THEN 'within_tolerance' ELSE 'worse_than_tolerance' END AS decision FROM m""")
def gate_decision(spark, sf_dir):
    gate = learning.gate_split(examples(spark, sf_dir), 120).filter("part = 'gate'")
    maes = gate.groupBy("signal").agg(F.avg(F.abs(F.col("ewma") - F.col("actual"))).alias("c"), F.avg(F.abs(F.col("persistence") - F.col("actual"))).alias("l"))
    return maes.select("signal", learning.gate_decision(F.col("c"), F.col("l")).alias("decision"))


@query("frozen_scores", f"WITH {EXAMPLES_SQL} SELECT signal, k, round(least(greatest(anchor + (0.5 * x_ma + 0.3 * x_ewma + 0.1 * x_trend) * greatest(vol, 1e-9), 0), 200), 6) AS predicted FROM examples")
def frozen_scores(spark, sf_dir):
    y = learning.linear_score(F.array("x_ma", "x_ewma", "x_trend"), F.array(F.lit(0.5), F.lit(0.3), F.lit(0.1)))
    return examples(spark, sf_dir).select("signal", "k", F.round(learning.from_target(y, F.col("anchor"), F.col("vol"), 0.0, 200.0), 6).alias("predicted"))


@query("top_coefficients", f"""WITH {EXAMPLES_SQL}, m AS (SELECT signal, avg(x_ma) AS a, avg(x_ewma) AS b, avg(x_trend) AS c FROM examples GROUP BY signal),
u AS (SELECT signal, t.place, t.name, t.weight FROM m, LATERAL (VALUES (0, 'x_ma', a), (1, 'x_ewma', b), (2, 'x_trend', c)) t(place, name, weight)),
r AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY abs(weight) DESC, place) AS rank FROM u) SELECT signal, name, round(weight, 6) + 0.0 AS weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def top_coefficients(spark, sf_dir):
    means = examples(spark, sf_dir).groupBy("signal").agg(F.array(F.avg("x_ma"), F.avg("x_ewma"), F.avg("x_trend")).alias("weights"))
    named = means.withColumn("names", F.array(F.lit("x_ma"), F.lit("x_ewma"), F.lit("x_trend")))
    return rounded(learning.top_coefficients(named, 2), ["weight"])


# -- store ---------------------------------------------------------------------------------------------------------------


@query("window_pivot", f"WITH {WIDE_SQL} SELECT k, {', '.join(f'round({s}, 6) AS {s}' for s in SIGNALS)} FROM wide")
def window_pivot(spark, sf_dir):
    return rounded(wide(spark, sf_dir), SIGNALS)


@query("iter_samples_limit_join", """WITH s AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 500)
SELECT s.o_orderkey, s.o_custkey, l.l_linenumber, l.l_quantity FROM s LEFT JOIN lineitem l ON l.l_orderkey = s.o_orderkey""")
def iter_samples_limit_join(spark, sf_dir):
    samples = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.expr("timestamp_ntz'1995-01-01 00:00:00'")).withColumnRenamed("o_orderkey", "l_orderkey")
    rows = store.samples_with_readings(samples, table(spark, sf_dir, "lineitem"), "l_orderkey", 500, ["o_orderdate", "l_orderkey"])
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), "o_custkey", "l_linenumber", "l_quantity")


@query("latest_n", f"WITH {READINGS_SQL} SELECT seq, signal, ts, value FROM readings ORDER BY ts DESC, seq DESC LIMIT 100")
def latest_n(spark, sf_dir):
    return store.newest(readings(spark, sf_dir), 100, ["ts", "seq"]).select("seq", "signal", "ts", "value")


@query("time_range", f"WITH {READINGS_SQL} SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM readings")
def time_range(spark, sf_dir):
    return readings(spark, sf_dir).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("count_by_run", f"WITH {READINGS_SQL} SELECT run, count(*) AS n, count(DISTINCT signal) AS signals FROM readings GROUP BY run")
def count_by_run(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("signal").alias("signals"))


@query("upsert_latest", f"WITH {READINGS_SQL} SELECT run, signal, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY run, signal ORDER BY seq DESC) AS n FROM readings) WHERE n = 1")
def upsert_latest(spark, sf_dir):
    return store.latest_by(readings(spark, sf_dir), ["run", "signal"], ["seq"]).select("run", "signal", "seq", "value")


NOW = 1_704_844_800.0  # 10 January 2024, 00:00 UTC: within the events


@query("due_predictions", f"WITH {BASE} SELECT signal, k AS id, ts_target FROM base WHERE k % 7 <> 0 AND ts_target <= {NOW} ORDER BY ts_target, k, signal LIMIT 200")
def due_predictions(spark, sf_dir):
    from tidegauge.plans.telemetry import forecasts

    rows = forecasts(spark, sf_dir).withColumns({"id": F.col("k"), "resolved": F.col("k") % 7 == 0})
    return rows.filter(~F.col("resolved") & (F.col("ts_target") <= NOW)).orderBy("ts_target", "id", "signal").limit(200).select("signal", "id", "ts_target")


@query("prediction_filters", f"WITH {BASE} SELECT signal, k, arm, round(predicted, 6) AS predicted FROM scored WHERE signal = 'view' AND arm IN ('ewma', 'persistence') AND ts_target >= {NOW} ORDER BY ts_target DESC, arm LIMIT 120")
def prediction_filters(spark, sf_dir):
    rows = scored(spark, sf_dir).filter((F.col("signal") == "view") & F.col("arm").isin("ewma", "persistence") & (F.col("ts_target") >= NOW))
    return rows.orderBy(F.desc("ts_target"), "arm").limit(120).select("signal", "k", "arm", F.round("predicted", 6).alias("predicted"))


VERSIONS_SQL = """versions AS (SELECT o_orderpriority AS kind, CAST(o_custkey % 40 AS BIGINT) AS scope, o_orderkey AS version_n, epoch_us(o_orderdate) / 1e6 AS created_ts,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lag(o_orderkey, 2) OVER (PARTITION BY o_orderpriority, o_custkey % 40 ORDER BY o_orderkey) END AS parent_n FROM orders),
activations AS (SELECT kind, scope, version_n, version_n AS seq FROM versions WHERE version_n % 4 = 0),
act AS (SELECT kind, scope, arg_max(version_n, seq) AS active_n FROM activations GROUP BY kind, scope)"""


def versions(spark, sf_dir):
    """A version log made of orders: (kind, scope, version_n, created_ts, parent_n), and the activation log of some of them."""
    from pyspark.sql import Window

    from tidegauge.sources.readings import epoch_seconds

    w = Window.partitionBy("kind", "scope").orderBy("version_n")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 40).alias("scope"), F.col("o_orderkey").alias("version_n"), epoch_seconds("o_orderdate").alias("created_ts"))
    log = rows.withColumn("parent_n", F.when(F.col("version_n") % 3 != 0, F.lag("version_n", 2).over(w)))
    return log, log.filter("version_n % 4 = 0").select("kind", "scope", "version_n", F.col("version_n").alias("seq"))


@query("version_latest", f"WITH {VERSIONS_SQL} SELECT kind, scope, active_n FROM act")
def version_latest(spark, sf_dir):
    return store.active(versions(spark, sf_dir)[1])


@query("next_version", f"WITH {VERSIONS_SQL} SELECT kind, scope, max(version_n) + 1 AS next_n FROM versions GROUP BY kind, scope")
def next_version(spark, sf_dir):
    return store.next_version(versions(spark, sf_dir)[0])


@query("version_prune", f"""WITH {VERSIONS_SQL}, m AS (SELECT v.*, a.active_n FROM versions v LEFT JOIN act a USING (kind, scope)),
i AS (SELECT *, row_number() OVER (PARTITION BY kind, scope ORDER BY created_ts DESC, version_n DESC) AS n FROM m WHERE active_n IS NULL OR version_n <> active_n),
g AS (SELECT kind, scope, version_n AS v FROM m WHERE version_n = active_n UNION ALL SELECT kind, scope, parent_n FROM m WHERE version_n = active_n AND parent_n IS NOT NULL)
SELECT kind, scope, version_n FROM i WHERE n > 5 AND NOT EXISTS (SELECT 1 FROM g WHERE g.kind = i.kind AND g.scope = i.scope AND g.v = i.version_n)""")
def version_prune(spark, sf_dir):
    return store.pruned(*versions(spark, sf_dir), keep=5)


@query("rollback_parent", f"""WITH {VERSIONS_SQL}, m AS (SELECT v.kind, v.scope, a.active_n, v.parent_n FROM versions v JOIN act a ON a.kind = v.kind AND a.scope = v.scope AND a.active_n = v.version_n)
SELECT m.kind, m.scope, m.active_n, coalesce(max(v.version_n) FILTER (v.version_n = m.parent_n), max(v.version_n) FILTER (v.version_n < m.active_n)) AS target_n FROM m JOIN versions v ON v.kind = m.kind AND v.scope = m.scope GROUP BY 1, 2, 3""")
def rollback_parent(spark, sf_dir):
    return store.rollback_target(*versions(spark, sf_dir))


@query("retention", f"WITH {READINGS_SQL} SELECT signal, count(*) AS kept FROM readings WHERE ts >= {NOW} GROUP BY signal")
def retention(spark, sf_dir):
    return store.retained(readings(spark, sf_dir), NOW).groupBy("signal").agg(F.count("*").alias("kept"))


@query("decimate", f"WITH {READINGS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY ts, seq) - 1 AS i, CAST(ceil(count(*) OVER (PARTITION BY signal) / 300.0) AS BIGINT) AS step FROM readings) SELECT seq, signal, value FROM p WHERE i % step = 0")
def decimate(spark, sf_dir):
    return store.decimated(readings(spark, sf_dir), 300, order=("ts", "seq")).select("seq", "signal", "value")


@query("semi_join_ids", "SELECT event_id, value FROM events WHERE event_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def semi_join_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("event_id"))
    return table(spark, sf_dir, "events").join(ids, "event_id", "left_semi").select("event_id", "value")


@query("feedback_counts", """SELECT d.source, count(*) FILTER (l.quality = 1) AS yes, count(*) FILTER (l.quality = 0) AS no, round(avg(CAST(l.quality AS DOUBLE)), 6) AS yes_share
FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY d.source""")
def feedback_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("yes"), F.count_if(F.col("quality") == 0).alias("no"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("yes_share"))


@query("feedback_summary", "SELECT count(*) AS total, count(*) FILTER (toxic = 1) AS flagged, count(*) FILTER (quality = 1 AND toxic = 0) AS useful, count(*) FILTER (quality = 0) AS useless FROM labels")
def feedback_summary(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("useful"), F.count_if(F.col("quality") == 0).alias("useless"))


# -- evidence ------------------------------------------------------------------------------------------------------------


@query("window_facts", f"""WITH {GRID}, p AS (SELECT * FROM grid WHERE ts BETWEEN {NOW - 86400} AND {NOW + 1} AND value IS NOT NULL)
SELECT signal, count(*) AS n, round(avg(value), 9) AS mean, round(min(value), 9) AS low, round(max(value), 9) AS high, round(arg_max(value, ts) - arg_min(value, ts), 9) + 0.0 AS change FROM p GROUP BY signal HAVING count(*) >= 2""")
def window_facts(spark, sf_dir):
    return rounded(evidence.window_facts(hourly(spark, sf_dir), NOW, 86400), ["mean", "low", "high", "change"], 9)


@query("battery_rate", f"""WITH {GRID}, f AS (SELECT signal, regr_slope(value, ts) * 60 AS per_minute, arg_max(value, ts) AS last FROM grid WHERE value IS NOT NULL GROUP BY signal)
SELECT signal, round(per_minute, 9) AS per_minute, round(last, 6) AS last, round(CASE WHEN per_minute < -1e-4 AND last > 10 THEN (last - 10) / -per_minute END, 2) AS minutes_to_10,
round(CASE WHEN per_minute < -1e-4 AND last > 0 THEN last / -per_minute END, 2) AS minutes_to_0 FROM f""")
def battery_rate(spark, sf_dir):
    rows = rounded(evidence.time_to_levels(hourly(spark, sf_dir), (10, 0)), ["per_minute"], 9)
    return rounded(rounded(rows, ["last"]), ["minutes_to_10", "minutes_to_0"], 2)


_DRIVERS, _LAGS = ("error", "purchase", "signup", "view"), (0, 1, 2, 3)


@query("driver_correlation", f"""WITH {WIDE_SQL}, s AS (SELECT click, {', '.join(f'lag({d}, {k}) OVER (ORDER BY k) AS {d}_{k}' for d in _DRIVERS for k in _LAGS)} FROM wide),
r AS ({' UNION ALL '.join(f"SELECT '{d}' AS driver, CAST({k} AS INTEGER) AS lag, count(*) AS n, corr(click, {d}_{k}) AS r FROM s WHERE click IS NOT NULL AND {d}_{k} IS NOT NULL" for d in _DRIVERS for k in _LAGS)}),
b AS (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY round(abs(r), 9) DESC, lag) AS p FROM r WHERE n >= 12 AND r IS NOT NULL)
SELECT driver, lag, n, round(r, 6) AS r FROM b WHERE p = 1""")
def driver_correlation(spark, sf_dir):
    return rounded(evidence.driver_correlations(wide(spark, sf_dir), "click", _DRIVERS, _LAGS, weakest=0.0), ["r"])


@query("active_forecasts", f"""WITH {BASE}, o AS (SELECT signal, ts, a.arm, a.p FROM resolved, LATERAL (VALUES ('persistence', persistence), ('ewma', ewma)) a(arm, p) WHERE actual IS NULL AND a.p IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY arm = 'ewma' DESC, ts DESC, arm) AS n FROM o) SELECT signal, ts, arm, round(p, 6) AS predicted FROM n WHERE n = 1""")
def active_forecasts(spark, sf_dir):
    from tidegauge.plans.telemetry import resolved

    open_ = resolved(spark, sf_dir).filter("actual IS NULL").select("signal", "ts", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("predicted")) for a in ("persistence", "ewma")])).alias("p")).select("signal", "ts", "p.*")
    return evidence.best_open_forecast(open_.filter("predicted IS NOT NULL"), "ewma", ["signal"]).withColumn("predicted", F.round("predicted", 6))


@query("history_quantiles", f"""WITH {BASE}, d AS (SELECT signal, actual - anchor AS delta FROM resolved WHERE actual IS NOT NULL AND anchor IS NOT NULL)
SELECT signal, count(*) AS n, round(quantile_cont(delta, 0.1), 6) AS p10, round(quantile_cont(delta, 0.5), 6) + 0.0 AS median, round(quantile_cont(delta, 0.9), 6) AS p90 FROM d GROUP BY signal HAVING count(*) >= 12""")
def history_quantiles(spark, sf_dir):
    from tidegauge.plans.telemetry import resolved

    rows = resolved(spark, sf_dir).filter("actual IS NOT NULL AND anchor IS NOT NULL").withColumn("delta", F.col("actual") - F.col("anchor"))
    return rounded(evidence.quantiles(rows, "delta", ["signal"]), ["p10", "median", "p90"])


@query("event_topk_union", """WITH a AS (SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20), b AS (SELECT event_id, event_type FROM events WHERE event_type = 'signup' ORDER BY event_id DESC LIMIT 20)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY event_id DESC LIMIT 12""")
def event_topk_union(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return evidence.newest_events(rows.filter("event_type = 'error'"), rows.filter("event_type = 'signup'"), 20, 12, ["event_id"])


__all__ = ["QUERIES", "SQL", "skill_report"]
