"""Queries of answers, evidence, logs and adaptation triggers, each with DuckDB SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.exprs import rounded
from tidegauge.operators import answers, evidence, learning, reports, store
from tidegauge.plans.reporting import NOW, WIDTH_SQL, versions, widths
from tidegauge.plans.telemetry import BASE, GRID, HOUR, QUERIES, SQL, hourly, query, scored
from tidegauge.sources.readings import READINGS_SQL, readings, table

NUM = r"[-+]?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?"


def _numbers_sql(text: str) -> str:
    """Numbers of a text: fixed phrases are matched whole and then left out."""
    found = rf"regexp_extract_all({text}, '(?i)top [13][0-9]{{0,2}}(?:,[0-9]{{3}})*(?:\.[0-9]+)?|24/7[0-9]{{0,2}}(?:,[0-9]{{3}})*(?:\.[0-9]+)?|1st|2nd|3rd|v00[12]|{NUM}')"
    return rf"list_transform(list_filter({found}, lambda x: regexp_full_match(x, '[-+]?[0-9,]+(\.[0-9]+)?')), lambda x: CAST(replace(x, ',', '') AS DOUBLE))"


@query("number_extraction", f"WITH n AS (SELECT doc_id, {_numbers_sql('coalesce(text, chr(32))')} AS v FROM documents) SELECT doc_id, len(v) AS n, round(coalesce(list_sum(v), 0.0), 3) AS total FROM n")
def number_extraction(spark, sf_dir):
    """Numbers of the whole text, with signs, thousands, decimals and exempt phrases."""
    rows = table(spark, sf_dir, "documents").select("doc_id", answers.numbers(F.coalesce("text", F.lit(""))).alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query("groundedness", """SELECT event_id, CAST(len(list_filter([value, value * 1.03, value + 50, -value], lambda s: list_bool_or(list_transform([round(value, 1), 400.0, 0.02],
lambda v: abs(s - v) <= greatest(0.15, 0.06 * abs(v)) OR abs(abs(s) - abs(v)) <= greatest(0.15, 0.06 * abs(v)))))) AS INTEGER) AS grounded FROM events""")
def groundedness(spark, sf_dir):
    v = F.col("value")
    said, surface = F.array(v, v * 1.03, v + 50, -v), F.array(F.round(v, 1), F.lit(400.0), F.lit(0.02), F.lit(None), F.lit(float("inf")))
    return table(spark, sf_dir, "events").select("event_id", answers.grounded(said, surface).alias("grounded"))


_INTENT_SQL = """CASE WHEN regexp_matches(q, 'forecast wrong|prediction wrong|was wrong|inaccurate|off by|mispredict|bad forecast|accuracy|how accurate|forecast was') THEN 'forecast_error'
WHEN regexp_matches(q, 'battery|charge|unplug|plugged|power last|last another|run out|discharge') THEN 'battery' WHEN regexp_matches(q, 'why|cause|because|reason|what made|driving|responsible') THEN 'why_change'
WHEN regexp_matches(q, 'unusual|weird|strange|anomal|abnormal|different than|changed compared|compared with|compared to') THEN 'anomaly'
WHEN regexp_matches(q, 'learn|adapt|model|version|rollback|retrain|improving') THEN 'adaptation' WHEN regexp_matches(q, 'will|predict|forecast|expect|next|going to') THEN 'forecast'
WHEN regexp_matches(q, 'trend|rising|falling|increasing|decreasing|climbing|dropping|spike') THEN 'trend' ELSE 'status' END"""


@query("intent_routing", f"SELECT {_INTENT_SQL} AS intent, count(*) AS n FROM (SELECT lower(text) AS q FROM conversations) GROUP BY 1")
def intent_routing(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(answers.intent("text").alias("intent")).agg(F.count("*").alias("n"))


_LABELS = {"click": "the time", "error": "problem", "view": "other", "purchase": "price of"}


@query("focus_signal", """SELECT conv_id, turn, CASE WHEN contains(q, 'the time') THEN 'click' WHEN contains(q, 'price of') THEN 'purchase' WHEN contains(q, 'problem') THEN 'error' WHEN contains(q, 'other') THEN 'view'
WHEN contains(q, 'memory') OR contains(q, 'ram') THEN 'mem.used_pct' WHEN contains(q, 'hot') THEN 'thermal.cpu_c' END AS focus FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations)""")
def focus_signal(spark, sf_dir):
    # Of the aliases of the temperature only one is asked for here.
    aliases = [a for a in answers.ALIASES if a[0] not in ("temperature", "temp")]
    found = answers.focus("text", _LABELS, aliases, [*_LABELS, "mem.used_pct", "thermal.cpu_c"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("focus"))


@query("style_checks", rf"""WITH t AS (SELECT conv_id, turn, text, lower(text) AS low, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare, {_numbers_sql('text')} AS v FROM conversations),
c AS (SELECT *, len(list_filter(regexp_split_to_array(regexp_replace(bare, '([0-9])\.([0-9])', '\1<DOT>\2', 'g'), '[.!?]+(?:\s|$)'), lambda p: regexp_matches(p, '\S'))) AS sentences,
  CASE WHEN regexp_matches(bare, '[.!?]\s') THEN regexp_extract(bare, '^((?s:.*?)[.!?])\s', 1) ELSE bare END AS first,
  len(list_filter(v, lambda n: abs(n - 10.0) <= 0.6 OR abs(n - 2.0) <= 0.15)) > 0 AS states FROM t),
f AS (SELECT *, [CASE WHEN sentences > 3 THEN 'too_long(' || sentences || '>3)' END, CASE WHEN NOT regexp_matches(first, '[0-9]') THEN 'no_number_in_first_sentence' END,
  CASE WHEN states AND NOT regexp_matches(low, 'likely|range|between|roughly|about|approximately|around|estimate|to |\+/-|±') THEN 'forecast_without_uncertainty' END,
  CASE WHEN turn % 2 = 0 AND NOT regexp_matches(low, '[0-9]+(?:\.[0-9]+)?\s*(?:h|hr|hrs|hour|hours|min|mins|minute|minutes)\b') THEN 'battery_without_duration' END,
  CASE WHEN conv_id % 2 = 0 AND regexp_matches(low, 'caused by|because of|due to|is causing|causes the') AND NOT regexp_matches(low, 'correlated|coincid|associated|alongside|tracks|moved with|strongest correlat|lines up with') THEN 'asserted_causation' END,
  CASE WHEN contains(low, 'the') AND NOT contains(low, 'that') THEN 'vocabulary(the->that)' END, CASE WHEN conv_id % 3 = 0 AND NOT contains(low, 'normal') THEN 'missing_rule_word(Normal)' END] AS bad FROM c)
SELECT conv_id, turn, CAST(3 + CAST(states AS INTEGER) + CAST(turn % 2 = 0 AS INTEGER) + CAST(conv_id % 2 = 0 AS INTEGER) + CAST(conv_id % 3 = 0 AS INTEGER) AS INTEGER) AS checks, array_to_string(list_filter(bad, lambda x: x IS NOT NULL), '; ') AS violations FROM f""")
def style_checks(spark, sf_dir):
    required = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("Normal"))).otherwise(F.array().cast("array<string>"))
    checks, bad = answers.style_violations(
        "text", 3, True, F.array(F.lit(10.0), F.lit(2.0)), F.col("turn") % 2 == 0, F.col("conv_id") % 2 == 0, {"the": "that"}, required)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", checks.alias("checks"), F.array_join(bad, "; ").alias("violations"))


_NOTES = ("  That's normal for me, cargo build. ", "cuda training is expected", "This backup should not run", "Unexpected low battery", "hello", "the stream call: no problem")


@query("rule_inference", r"""WITH n AS (SELECT conv_id, turn, ['  That''s normal for me, cargo build. ', 'cuda training is expected', 'This backup should not run', 'Unexpected low battery', 'hello', 'the stream call: no problem'][(conv_id + turn) % 6 + 1] AS text FROM conversations),
t AS (SELECT *, lower(text) AS q FROM n), v AS (SELECT *, CASE
WHEN regexp_matches(q, 'shouldn''t|should not|not normal|unexpected|problem|worrying') THEN 'concerning'
WHEN regexp_matches(q, 'that''s normal|thats normal|is normal|normal for me|normal for my|treat that as normal|expected|always happens|happens when i|on purpose|deliberate|that''s fine|thats fine|no problem') THEN 'normal' END AS verdict FROM t)
SELECT conv_id, turn, verdict, CASE WHEN regexp_matches(q, 'compil|build|cargo|make|gradle|webpack|rustc|linking') THEN 'build' WHEN regexp_matches(q, 'game|gaming|render|cuda|train|inference|gpu') THEN 'gpu_heavy'
WHEN regexp_matches(q, 'backup|sync|index|copy|download large') THEN 'io_heavy' WHEN regexp_matches(q, 'unplugged|on battery|low battery') THEN 'battery_constrained' WHEN regexp_matches(q, 'charging|plugged in') THEN 'charging'
WHEN regexp_matches(q, 'video|stream|movie|call|zoom|meet') THEN 'media' ELSE '*' END AS regime, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 160) AS note,
CASE verdict WHEN 'normal' THEN 'normal' ELSE 'unusual' END AS required_word FROM v WHERE verdict IS NOT NULL""")
def rule_inference(spark, sf_dir):
    note = F.element_at(F.array(*map(F.lit, _NOTES)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.inferred_rule(note).alias("rule"))
    return rows.filter("rule IS NOT NULL").select("conv_id", "turn", "rule.*")


def feedback(spark, sf_dir):
    """A feedback log made of conversations: (id, ts, kind, text)."""
    kind = F.element_at(F.array(*map(F.lit, ("note", "label", "forecast_useful"))), (F.col("turn") % 3 + 1).cast("int"))
    ident = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(ident.alias("id"), (ident % 977).cast("double").alias("ts"), kind.alias("kind"), "text")


FEEDBACK_SQL = "feedback AS (SELECT conv_id * 1000 + turn AS id, CAST((conv_id * 1000 + turn) % 977 AS DOUBLE) AS ts, ['note', 'label', 'forecast_useful'][turn % 3 + 1] AS kind, text FROM conversations)"


@query("user_context", rf"""WITH {FEEDBACK_SQL}, n AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM (SELECT * FROM feedback ORDER BY ts DESC, id DESC LIMIT 60))
SELECT id, ts, CASE kind WHEN 'label' THEN 'User labels this behaviour: "' ELSE 'User note: "' END || bare || '"' AS line FROM n WHERE kind <> 'forecast_useful' AND bare <> '' ORDER BY ts DESC, id DESC LIMIT 8""")
def user_context(spark, sf_dir):
    return evidence.user_context(feedback(spark, sf_dir))


@query("feedback_list", f"""WITH {FEEDBACK_SQL}, m AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'v' || (id % 3) END AS consumed_by FROM feedback)
SELECT id, ts, kind FROM m WHERE ts >= 100 AND kind = 'note' AND consumed_by IS NULL ORDER BY ts DESC, id LIMIT 500""")
def feedback_list(spark, sf_dir):
    """The newest notes that no adapter has consumed; consumption is a log."""
    rows = feedback(spark, sf_dir)
    log = rows.filter("id % 5 = 0").select("id", F.col("ts").alias("at"), F.concat(F.lit("v"), (F.col("id") % 3).cast("string")).alias("consumed_by"))
    marked = store.with_log(rows.withColumn("consumed_by", F.lit(None).cast("string")), log, "id", ["at"], ["consumed_by"])
    return store.listed(marked.filter("consumed_by IS NULL"), [F.desc("ts"), F.col("id")], 500, ("ts", 100.0), kind="note").select("id", "ts", "kind")


@query("resolution_log", """WITH n AS (SELECT l_orderkey AS id, max(struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_extendedprice)) AS x FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT o_orderkey AS id, x.d AS actual, round(o_totalprice - x.d, 4) AS error, x IS NOT NULL AS resolved FROM orders LEFT JOIN n ON n.id = o_orderkey""")
def resolution_log(spark, sf_dir):
    """Predictions with the newest entry of their resolution log."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    log = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("actual"))
    found = store.with_log(rows, log, "id", ["l_linenumber", "l_partkey", "l_suppkey", "actual"], ["actual"])
    return found.select("id", "actual", F.round(F.col("value") - F.col("actual"), 4).alias("error"), F.col("actual").isNotNull().alias("resolved"))


@query("prediction_by_id", "SELECT o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_orderkey IN (1, 7, 32, 100000)")
def prediction_by_id(spark, sf_dir):
    return store.by_id(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")), [1, 7, 32, 100_000])


@query("run_log", """WITH r AS (SELECT o_custkey AS run_id, o_orderkey, o_orderstatus, o_totalprice FROM orders), s AS (SELECT run_id, min(o_orderkey) AS started FROM r GROUP BY 1), e AS (SELECT run_id, arg_max(o_orderkey, o_orderkey) AS ended, arg_max(o_orderstatus, o_orderkey) AS status FROM r WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT s.run_id, started, ended, coalesce(status, 'running') AS status FROM s LEFT JOIN e USING (run_id) ORDER BY started DESC LIMIT 100""")
def run_log(spark, sf_dir):
    """The newest runs: starts, with the newest end that the log has."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ended"), F.col("o_orderstatus").alias("status"))
    starts = rows.groupBy("run_id").agg(F.min("ended").alias("started"))
    runs = store.with_log(starts, rows.filter("status <> 'O'"), "run_id", ["ended"], ["ended", "status"])
    return store.listed(runs.withColumn("status", F.coalesce("status", F.lit("running"))), [F.desc("started")], 100).select("run_id", "started", "ended", "status")


@query("version_history", "SELECT o_orderpriority AS kind, CAST(o_custkey % 40 AS BIGINT) AS scope, o_orderkey AS version_n FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def version_history(spark, sf_dir):
    return store.listed(versions(spark, sf_dir)[0], [F.desc("created_ts"), F.desc("version_n")], 500, kind="1-URGENT").select("kind", "scope", "version_n")


@query("metrics_scan", f"WITH {BASE}, m AS (SELECT arm, signal, horizon, count(*) AS n, round(avg(abs_error), 6) AS mae FROM scored GROUP BY ALL) SELECT * FROM m WHERE signal = 'view' ORDER BY signal, horizon, arm LIMIT 2000")
def metrics_scan(spark, sf_dir):
    rows = rounded(reports.metrics(scored(spark, sf_dir), ["arm", *reports.SCOPE]), ["mae"]).select("arm", "signal", "horizon", "n", "mae")
    return store.listed(rows, [F.col("signal"), F.col("horizon"), F.col("arm")], 2000, signal="view", arm=None)


@query("model_versions_used", "SELECT o_orderpriority AS arm, CAST(o_custkey % 40 AS BIGINT) AS scope, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS versions, count(*) AS n FROM orders GROUP BY 1, 2")
def model_versions_used(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 40).alias("scope"))
    return rows.agg(F.array_join(reports.distinct_versions("o_orderstatus"), ",").alias("versions"), F.count("*").alias("n"))


@query("interval_clip", f"WITH {WIDTH_SQL} SELECT signal, k, round(least(greatest(predicted - width, 0.0), 200.0), 6) AS lo, round(least(greatest(predicted + width, 0.0), 200.0), 6) AS hi FROM widths WHERE width IS NOT NULL")
def interval_clip(spark, sf_dir):
    lo, hi = reports.clipped_interval(F.col("predicted"), F.col("width"), 0.0, 200.0)
    return widths(spark, sf_dir).filter("width IS NOT NULL").select("signal", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


#: A clock a day after the readings, and one by which only some signals' readings are fresh.
_LATER, _AMONG = 1_706_745_600.0, 1_706_658_900.0


@query("reference_now", f"WITH {READINGS_SQL} SELECT CASE WHEN {_LATER} - max(ts) > 300 THEN max(ts) ELSE {_LATER} END AS now, coalesce({_LATER} - max(ts) <= 300, true) AS live FROM readings")
def reference_now(spark, sf_dir):
    return store.reference_now(readings(spark, sf_dir), _LATER)


@query("reference_now_by_signal", f"WITH {READINGS_SQL} SELECT signal, CASE WHEN {_AMONG} - max(ts) > 300 THEN max(ts) ELSE {_AMONG} END AS now, {_AMONG} - max(ts) <= 300 AS live FROM readings GROUP BY signal")
def reference_now_by_signal(spark, sf_dir):
    return store.reference_now(readings(spark, sf_dir), _AMONG, ["signal"])


@query("current_facts", f"""WITH {GRID}, n AS (SELECT max(ts) AS ts FROM grid), p AS (SELECT unnest(['signup', 'view', 'click']) AS signal, unnest([1, 2, 3]) AS place)
SELECT place, g.signal, round(value, 6) AS value, g.ts, {NOW} - g.ts AS age FROM grid g JOIN n ON g.ts = n.ts JOIN p ON p.signal = g.signal WHERE value IS NOT NULL""")
def current_facts(spark, sf_dir):
    return rounded(evidence.current_facts(hourly(spark, sf_dir), NOW, ("view", "click"), "signup"), ["value"])


_WEEK = 7 * 24 * HOUR
_ACCURACY = f"""SELECT arm, signal, horizon, count(*) AS n, avg(abs_error) AS mae FROM scored WHERE ts_target BETWEEN {NOW - _WEEK} AND {NOW} GROUP BY ALL"""


@query("accuracy_facts", f"""WITH {BASE}, m AS ({_ACCURACY}) SELECT m.arm, m.signal, m.horizon, m.n, round(m.mae, 6) AS mae, round(CASE WHEN r.mae > 0 THEN 1 - m.mae / r.mae END, 6) + 0.0 AS skill
FROM m LEFT JOIN m r ON r.signal = m.signal AND r.horizon = m.horizon AND r.arm = 'persistence' WHERE m.n >= 10""")
def accuracy_facts(spark, sf_dir):
    return rounded(evidence.accuracy_facts(scored(spark, sf_dir), NOW, _WEEK), ["mae", "skill"])


@query("evidence_pack", f"""WITH {GRID}, n AS (SELECT max(ts) AS ts FROM grid), p AS (SELECT unnest(['view', 'click']) AS signal, unnest([1, 2]) AS place),
c AS (SELECT count(*) AS current, round(coalesce(sum(value), 0.0), 6) AS total FROM grid JOIN n USING (ts) JOIN p USING (signal) WHERE value IS NOT NULL),
w AS (SELECT count(*) AS facts FROM (SELECT signal FROM grid WHERE ts BETWEEN {NOW - 86400} AND {NOW + 1} AND value IS NOT NULL GROUP BY signal HAVING count(*) >= 2))
SELECT CAST({NOW} AS DOUBLE) AS now, 'why_change' AS intent, CAST(current AS INTEGER) AS current, total, CAST(facts AS INTEGER) AS window_facts FROM c, w""")
def evidence_pack(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    pack = evidence.evidence_pack(NOW, answers.intent(F.lit("Why is it busy?")), current=evidence.current_facts(rows, NOW, ("view", "click")), window=evidence.window_facts(rows, NOW, 86400))
    total = F.round(F.aggregate("current", F.lit(0.0), lambda s, f: s + f["value"]), 6)
    return pack.select("now", "intent", F.size("current").alias("current"), total.alias("total"), F.size("window").alias("window_facts"))


_NAMES = ("gcc worker", "Firefox", "ollama run", "containerd-shim", "nvim", "kworker/3", "sshd", "cargo build", "obs", "Xorg")


@query("process_attribution", r"""WITH p AS (SELECT p_size AS tick, ['gcc worker', 'Firefox', 'ollama run', 'containerd-shim', 'nvim', 'kworker/3', 'sshd', 'cargo build', 'obs', 'Xorg'][p_partkey % 10 + 1] AS name, p_retailprice AS load, p_partkey FROM part),
c AS (SELECT *, CASE p_partkey % 10 WHEN 0 THEN 'build' WHEN 1 THEN 'browser' WHEN 2 THEN 'ml' WHEN 3 THEN 'container' WHEN 4 THEN 'editor' WHEN 5 THEN 'system' WHEN 7 THEN 'build' WHEN 8 THEN 'media' END AS c, row_number() OVER (PARTITION BY tick ORDER BY load DESC) AS n FROM p)
SELECT tick, round(coalesce(sum(load) FILTER (c = 'build'), 0), 4) AS load_build, round(coalesce(sum(load) FILTER (c = 'browser'), 0), 4) AS load_browser, round(coalesce(sum(load) FILTER (c = 'media'), 0), 4) AS load_media, round(coalesce(sum(load) FILTER (c = 'ml'), 0), 4) AS load_ml,
round(coalesce(sum(load) FILTER (c = 'container'), 0), 4) AS load_container, round(coalesce(sum(load) FILTER (c = 'editor'), 0), 4) AS load_editor, round(coalesce(sum(load) FILTER (c = 'system'), 0), 4) AS load_system,
max(load) AS top1, round(sum(load) FILTER (n <= 3) / sum(load), 6) AS concentration FROM c GROUP BY tick""")
def process_attribution(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("tick"), name.alias("name"), F.col("p_retailprice").alias("load"))
    loads = [f"load_{n}" for n, _ in evidence.CATEGORIES]
    return rounded(rounded(evidence.attribution(rows, ["tick"]), loads, 4), ["concentration"])


@query("adaptation_trigger", """SELECT o_orderkey AS scope, CASE WHEN o_orderkey % 13 = 0 THEN 'drift' WHEN o_custkey % 400 >= 240 THEN 'periodic_samples' WHEN (o_orderkey % 7 = 0 OR o_orderkey % 5000 >= 3600) AND o_custkey % 400 > 0 THEN 'periodic_time'
WHEN o_totalprice >= 300000 THEN 'error' END AS trigger FROM orders""")
def adaptation_trigger(spark, sf_dir):
    """Which policy sets off an adaptation of each scope's state."""
    last = F.when(F.col("o_orderkey") % 7 != 0, 5000.0 - F.col("o_orderkey") % 5000)
    due = learning.trigger(F.col("o_orderkey") % 13 == 0, F.col("o_custkey") % 400, last, F.lit(5000.0), F.col("o_totalprice"), every=240, seconds=3600.0, budget=300_000.0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scope"), due.alias("trigger"))


@query("drift_routing", """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS signal, CASE WHEN event_id % 3 = 0 THEN 600 END AS horizon,
CASE event_id % 3 WHEN 1 THEN event_type || '|lag_0' WHEN 2 THEN 'time|sin_day' END AS feature FROM events), s AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS signal), h AS (SELECT unnest([600, 3600]) AS horizon)
SELECT s.signal, h.horizon, count(*) AS alarms FROM e, s, h WHERE CASE WHEN e.signal IS NOT NULL THEN e.signal = s.signal AND e.horizon = h.horizon WHEN e.feature LIKE 'time|%' THEN true ELSE split_part(e.feature, '|', 1) = s.signal END GROUP BY 1, 2""")
def drift_routing(spark, sf_dir):
    """How many alarms reach each scope: an error's alarm its own, a feature's those of its signal, a shared feature's all."""
    n, own = F.col("event_id") % 3, F.col("event_id") % 3 == 0
    feature = F.when(n == 1, F.concat("event_type", F.lit("|lag_0"))).when(n == 2, "time|sin_day")
    events = table(spark, sf_dir, "events").select(F.when(own, F.col("event_type")).alias("signal"), F.when(own, 600).alias("horizon"), feature.alias("feature"))
    scopes = spark.range(1).select(F.explode(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))).alias("signal")).select("signal", F.explode(F.array(F.lit(600), F.lit(3600))).alias("horizon"))
    return learning.routed(events, scopes).groupBy("signal", "horizon").agg(F.count("*").alias("alarms"))


__all__ = ["QUERIES", "SQL"]
