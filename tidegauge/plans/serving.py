"""Queries behind a dashboard and its answers: series, forecasts, prediction details, replies, persona, sources, retention; each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegauge.functions.exprs import rounded
from tidegauge.operators import answers, evidence, replies, store
from tidegauge.plans.answering import _INTENT_SQL, FEEDBACK_SQL, _numbers_sql, feedback
from tidegauge.plans.reporting import NOW
from tidegauge.plans.telemetry import BASE, HORIZON, HOUR, QUERIES, SQL, VECTOR_NAMES, WIDE_SQL, feature_vector_all, hourly, query, resolved
from tidegauge.session import shared_dir
from tidegauge.sources import collect, datasets, telemetry
from tidegauge.sources.readings import READINGS_SQL, readings, table

_WEEK = 7 * 24 * HOUR


@query("api_telemetry", f"""WITH {WIDE_SQL}, p AS (SELECT k, k * {HOUR} AS ts, click, view FROM wide WHERE k * {HOUR} BETWEEN {NOW - _WEEK} AND {NOW + 1}),
n AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS step FROM p) SELECT k, ts, round(click, 6) AS click, round(view, 6) AS view FROM n WHERE i % step = 0""")
def api_telemetry(spark, sf_dir):
    """A week of two signals in at most 50 points."""
    return rounded(store.series(hourly(spark, sf_dir), ("click", "view"), NOW, _WEEK, 50), ["click", "view"])


@query("api_forecasts", f"""WITH {BASE} SELECT 'actual' AS part, ts, round(value, 6) AS value, CAST(NULL AS DOUBLE) AS error FROM grid WHERE signal = 'view' AND ts BETWEEN {NOW - _WEEK} AND {NOW + 1}
UNION ALL SELECT 'resolved', ts_target, round(ewma, 6), round(ewma - actual, 6) + 0.0 FROM resolved WHERE signal = 'view' AND ewma IS NOT NULL AND actual IS NOT NULL AND ts_target BETWEEN {NOW - _WEEK} AND {NOW}
UNION ALL SELECT * FROM (SELECT 'pending', ts_target, round(ewma, 6), CAST(NULL AS DOUBLE) FROM resolved WHERE signal = 'view' AND ewma IS NOT NULL AND actual IS NULL ORDER BY ts DESC LIMIT 400)""")
def api_forecasts(spark, sf_dir):
    """One signal's readings, its forecasts that came due, and those still open, as one list."""
    none = F.lit(None).cast("double")
    mine = resolved(spark, sf_dir).filter("signal = 'view' AND ewma IS NOT NULL")
    error = F.when(F.col("actual").isNotNull(), F.round(F.col("ewma") - F.col("actual"), 6) + 0.0)
    actual = hourly(spark, sf_dir).filter((F.col("signal") == "view") & F.col("ts").between(NOW - _WEEK, NOW + 1)).select(F.lit("actual").alias("part"), "ts", F.round("value", 6).alias("value"), none.alias("error"))
    due = mine.filter(F.col("actual").isNotNull() & F.col("ts_target").between(NOW - _WEEK, NOW)).select(F.lit("resolved").alias("part"), F.col("ts_target").alias("ts"), F.round("ewma", 6).alias("value"), error.alias("error"))
    pending = store.newest(mine.filter("actual IS NULL"), 400, ["ts"]).select(F.lit("pending").alias("part"), F.col("ts_target").alias("ts"), F.round("ewma", 6).alias("value"), none.alias("error"))
    return actual.unionByName(due).unionByName(pending)


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in VECTOR_NAMES) + "]"


@query("api_prediction_features", f"""WITH v AS ({SQL['feature_vector_all']}), e AS (SELECT k, unnest({_NAMES_SQL}) AS name, unnest(vec) AS value, unnest(range(len(vec))) AS place FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(value) DESC, place) AS n FROM e) SELECT k, CAST(n AS INTEGER) AS place, name, value FROM n WHERE n <= 15""")
def api_prediction_features(spark, sf_dir):
    """The 15 greatest features of every tick's vector."""
    rows = store.top_features(feature_vector_all(spark, sf_dir), VECTOR_NAMES)
    return rows.select("k", F.posexplode("features").alias("place", "f")).select("k", (F.col("place") + 1).alias("place"), "f.*")


def _cutoff_sql(name: str, key: str) -> str:
    return f"SELECT {key} FROM {name} WHERE o_orderdate >= TIMESTAMP '1996-01-01'"


@query("retention_cascade", f"""SELECT 'samples' AS part, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' UNION ALL SELECT 'readings', count(*) FROM lineitem WHERE l_orderkey IN ({_cutoff_sql('orders', 'o_orderkey')})
UNION ALL SELECT 'removed', count(*) FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1996-01-01')""")
def retention_cascade(spark, sf_dir):
    """Retention takes the readings of a removed sample with it."""
    from tidegauge.sources.readings import epoch_seconds

    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), epoch_seconds("o_orderdate").alias("ts"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"))
    kept, with_sample, _, removed = store.retained_with(samples, rows, samples, 820_454_400.0)
    parts = kept.agg(F.lit("samples").alias("part"), F.count("*").alias("n")).unionByName(with_sample.agg(F.lit("readings").alias("part"), F.count("*").alias("n")))
    return parts.unionByName(removed.select(F.lit("removed").alias("part"), F.col("removed").alias("n")))


# -- sources -------------------------------------------------------------------------------------------------------------


@query("merge_registry", """WITH s AS (SELECT p_type AS signal, p_name AS source, p_partkey AS place, p_brand AS unit, CAST(p_size AS DOUBLE) AS lo FROM part WHERE p_partkey % 4 <> 0),
f AS (SELECT *, first_value(unit) OVER w AS fu, first_value(lo) OVER w AS fl, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY signal ORDER BY place))
SELECT signal, min(source) FILTER (n = 1) AS source, min(unit) FILTER (n = 1) AS unit, min(lo) FILTER (n = 1) AS lo, count(*) FILTER (unit IS DISTINCT FROM fu OR lo IS DISTINCT FROM fl) AS conflicts FROM f GROUP BY signal""")
def merge_registry(spark, sf_dir):
    specs = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("signal"), F.col("p_name").alias("source"), F.col("p_partkey").alias("place"), (F.col("p_partkey") % 4 != 0).alias("available"), F.col("p_brand").alias("unit"), F.col("p_size").cast("double").alias("lo"))
    return collect.merged(specs, fields=("unit", "lo"))


_EVERY = 400.0


@query("source_quarantine", f"""WITH RECURSIVE {READINGS_SQL}, a AS (SELECT CAST(run AS VARCHAR) || signal AS source, ts, seq, (seq // 8) % 3 > 0 AS ok, CASE WHEN seq % 9 <> 0 THEN value END AS value, row_number() OVER (PARTITION BY run, signal ORDER BY ts, seq) AS n FROM readings),
m AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS ts, CAST(NULL AS BIGINT) AS seq, '' AS state, CAST(NULL AS DOUBLE) AS value, 0 AS failures, 0.0::DOUBLE AS until, 0.0::DOUBLE AS sampled, CAST(NULL AS DOUBLE) AS held FROM (SELECT DISTINCT source FROM a)
UNION ALL SELECT source, n, ts, seq, state, CASE state WHEN 'read' THEN new WHEN 'reused' THEN held END, CASE state WHEN 'read' THEN 0 WHEN 'failed' THEN failures + 1 ELSE failures END,
CASE WHEN state = 'read' THEN 0.0 WHEN state = 'failed' AND failures + 1 >= 3 THEN ts + CASE failures + 1 WHEN 3 THEN 5.0 WHEN 4 THEN 15.0 WHEN 5 THEN 60.0 ELSE 300.0 END ELSE until END,
CASE state WHEN 'read' THEN ts ELSE sampled END, CASE state WHEN 'read' THEN coalesce(new, held) ELSE held END
FROM (SELECT a.source, a.n, a.ts, a.seq, a.value AS new, m.failures, m.until, m.sampled, m.held, CASE WHEN m.until > a.ts THEN 'quarantined' WHEN a.ts - m.sampled < {_EVERY} THEN 'reused' WHEN a.ok THEN 'read' ELSE 'failed' END AS state
FROM m JOIN a ON a.source = m.source AND a.n = m.n + 1)) SELECT source, ts, seq, state, value FROM m WHERE n > 0""")
def source_quarantine(spark, sf_dir):
    """Which ticks of sources that often fail are read, left alone or answered by the value before."""
    rows = readings(spark, sf_dir).select(
        F.concat(F.col("run").cast("string"), "signal").alias("source"), "ts", "seq", (F.floor(F.col("seq") / 8) % 3 > 0).alias("ok"), F.when(F.col("seq") % 9 != 0, F.col("value")).alias("value"))
    return collect.read_all(rows, _EVERY)


# -- replies -------------------------------------------------------------------------------------------------------------

_FACTS_SQL = f"""facts AS (SELECT (SELECT value FROM ({SQL['current_facts']}) WHERE signal = 'click') AS now, (SELECT change FROM ({SQL['window_facts']}) WHERE signal = 'click') AS change,
(SELECT predicted FROM ({SQL['active_forecasts']}) WHERE signal = 'click') AS fc, (SELECT mae FROM ({SQL['accuracy_facts']}) WHERE signal = 'click' AND arm = 'ewma') AS mae),
asked AS (SELECT conv_id, turn, text, {_INTENT_SQL} AS intent FROM (SELECT conv_id, turn, text, lower(text) AS q FROM conversations)),
c AS (SELECT *, 'click is ' || printf('%.1f', now) || ' now.' AS a, 'It went ' || CASE WHEN change > 0 THEN 'up' ELSE 'down' END || ' by ' || printf('%.1f', abs(change)) || ' in 24.0 h.' AS b,
'click is expected at ' || printf('%.1f', fc) || ' in 3.0 h, a range is not known yet.' AS f, 'The mean error was ' || printf('%.1f', mae) || '.' AS e, CASE WHEN conv_id % 3 = 0 THEN 'This is normal for you.' END AS r FROM asked, facts),
o AS (SELECT *, list_filter(CASE intent WHEN 'battery' THEN [a, f] WHEN 'forecast' THEN [a, f, b] WHEN 'forecast_error' THEN [e, a] WHEN 'anomaly' THEN [a, b] WHEN 'adaptation' THEN [e] ELSE [a, b, f] END, lambda x: x IS NOT NULL) AS s,
CASE WHEN intent IN ('battery', 'why_change', 'forecast', 'anomaly', 'status') THEN r END AS rule FROM c),
l AS (SELECT *, list_concat(list_slice(s, 1, 2 - CAST(rule IS NOT NULL AS INTEGER)), CASE WHEN rule IS NULL THEN [] ELSE [rule] END) AS said FROM o),
answer AS (SELECT conv_id, turn, text, intent, now, change, fc, mae, CASE WHEN len(said) = 0 THEN 'Nothing is known yet.' ELSE array_to_string(said, ' ') END AS answer FROM l)"""


def _answered(spark, sf_dir):
    """Every line of the conversations as a question about one signal, with the facts at hand and the answer in two sentences."""
    mine = lambda df, c, arm=None: df.filter((F.col("signal") == "click") & (F.col("arm") == arm if arm else F.lit(True))).agg(F.max(c).alias(c))
    hours = hourly(spark, sf_dir)
    parts = [
        mine(rounded(evidence.current_facts(hours, NOW, ("view", "click"), "signup"), ["value"]), "value").withColumnRenamed("value", "now"), mine(QUERIES["window_facts"](spark, sf_dir), "change"),
        mine(QUERIES["active_forecasts"](spark, sf_dir), "predicted").withColumnRenamed("predicted", "fc"), mine(QUERIES["accuracy_facts"](spark, sf_dir), "mae", "ewma")]
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.crossJoin(part)  # one row each
    clauses = {
        "now": replies.now_clause("click", F.col("now")), "change": replies.change_clause(F.col("change"), 24 * HOUR), "forecast": replies.forecast_clause("click", HORIZON, F.col("fc")),
        "accuracy": F.when(F.col("mae").isNotNull(), F.concat(F.lit("The mean error was "), replies.one_decimal(F.col("mae")), F.lit("."))),
        "rule": F.when(F.col("conv_id") % 3 == 0, "This is normal for you.")}
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").crossJoin(F.broadcast(facts))
    named = rows.withColumn("intent", answers.intent("text"))
    return named.withColumn("answer", replies.assembled(F.col("intent"), clauses, F.lit("Nothing is known yet."), 2))


@query("rendered_answers", f"WITH {_FACTS_SQL} SELECT conv_id, turn, intent, answer FROM answer")
def rendered_answers(spark, sf_dir):
    return _answered(spark, sf_dir).select("conv_id", "turn", "intent", "answer")


@query("served_answers", rf"""WITH {_FACTS_SQL}, g AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM answer), n AS (SELECT *, {_numbers_sql('bare')} AS v FROM g),
h AS (SELECT *, len(list_filter(v, lambda s: list_bool_or(list_transform(list_filter([now, change, fc, mae], lambda x: x IS NOT NULL), lambda x: abs(s - x) <= greatest(0.15, 0.06 * abs(x)) OR abs(abs(s) - abs(x)) <= greatest(0.15, 0.06 * abs(x)))))) AS held FROM n),
r AS (SELECT *, CASE WHEN coalesce(bare, '') = '' THEN 'empty_generation' WHEN held < len(v) THEN 'ungrounded_numbers' END AS reason FROM h)
SELECT conv_id, turn, CASE WHEN reason IS NULL THEN bare ELSE answer END AS served, reason, round(CASE WHEN reason = 'empty_generation' OR len(v) = 0 THEN 1.0 ELSE held / len(v) END, 6) AS groundedness FROM r""")
def served_answers(spark, sf_dir):
    """Each line as what a model said: kept where its numbers stand for facts, else the rendered answer."""
    text, reason, share = replies.served("text", "answer", F.array("now", "change", "fc", "mae"))
    return _answered(spark, sf_dir).select("conv_id", "turn", text.alias("served"), reason.alias("reason"), F.round(share, 6).alias("groundedness"))


@query("persona", rf"""WITH {FEEDBACK_SQL}, n AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare, CASE WHEN id % 4 = 0 THEN 'Yes' ELSE 'no' END AS label FROM feedback ORDER BY ts DESC, id DESC LIMIT 200),
t AS (SELECT *, lower(bare) AS q, CASE WHEN kind IN ('note', 'label') AND bare <> '' THEN CASE
WHEN regexp_matches(lower(bare), 'shouldn''t|should not|not normal|unexpected|problem|worrying') THEN 'concerning'
WHEN regexp_matches(lower(bare), 'that''s normal|thats normal|is normal|normal for me|normal for my|treat that as normal|expected|always happens|happens when i|on purpose|deliberate|that''s fine|thats fine|no problem') THEN 'normal' END END AS verdict FROM n),
r AS (SELECT verdict, substr(bare, 1, 160) AS note, min((ts, id)) AS first_at FROM t WHERE verdict IS NOT NULL GROUP BY 1, 2), c AS (SELECT bare, min((ts, id)) AS first_at FROM t WHERE kind IN ('note', 'label') AND bare <> '' AND verdict IS NULL GROUP BY 1),
u AS (SELECT count(*) FILTER (kind = 'forecast_useful' AND label = 'Yes') AS useful, count(*) FILTER (kind = 'forecast_useful' AND label <> 'Yes') AS useless FROM n)
SELECT coalesce((SELECT string_agg(verdict || ': ' || note, '|' ORDER BY first_at) FROM r), '') AS rules, coalesce((SELECT string_agg(bare, '|' ORDER BY first_at) FROM c), '') AS context, useful, useless,
CASE WHEN useless > useful + 2 THEN 5 WHEN useful > useless + 4 THEN 3 ELSE 4 END AS sentences,
CAST((SELECT count(*) FROM r) + (SELECT count(*) FROM c) + CAST(useless > useful + 2 OR useful > useless + 4 AS INTEGER) AS INTEGER) AS revision FROM u""")
def persona(spark, sf_dir):
    rows = feedback(spark, sf_dir).withColumn("label", F.when(F.col("id") % 4 == 0, "Yes").otherwise("no"))
    rules = F.array_join(F.transform("rules", lambda r: F.concat(r["verdict"], F.lit(": "), r["note"])), "|")
    return replies.persona(rows).select(rules.alias("rules"), F.array_join("context", "|").alias("context"), "useful", "useless", "sentences", "revision")


__all__ = ["QUERIES", "SQL"]


@query("telemetry_source", f"""WITH {READINGS_SQL}, q AS (SELECT signal, CASE WHEN seq % 5 <> 0 THEN value END AS value, CAST(CASE seq % 5 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS quality, ts FROM readings)
SELECT signal, quality, count(*) AS n, count(value) AS usable, round(sum(value), 4) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM q GROUP BY signal, quality""")
def telemetry_source(spark, sf_dir):
    """All readings written as a dataset and read again through the data source, by signal and quality."""
    rows = readings(spark, sf_dir)
    bad = F.col("seq") % 5
    reading = F.struct(F.when(bad != 0, F.col("value")).alias("value"), F.when(bad == 0, 5).when(bad == 1, 2).otherwise(0).alias("quality"))
    none = F.lit(None).cast("double")
    samples = rows.select("ts", F.col("seq").cast("string").alias("origin"), none.alias("gap_s"), none.alias("collect_ms"), F.create_map("signal", reading).alias("readings"))
    path = f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    datasets.write(samples, rows.select(F.col("signal").alias("name")).distinct(), path)
    telemetry.register(spark)
    found = spark.read.format("telemetry").load(path).groupBy("signal", "quality")
    return found.agg(F.count("*").alias("n"), F.count("value").alias("usable"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
