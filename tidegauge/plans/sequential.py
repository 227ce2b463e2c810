"""Queries of the sequential kernels.

The detectors, the adaptive interval and the regression have SQL: a recursive
statement that takes one tick a round, written from the rule. The others' rows
are checked against plain models in the tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.exprs import rounded
from tidegauge.operators import baselines, experiments, features, replay, reports, scan, states
from tidegauge.plans.telemetry import BASE, EXAMPLES_SQL, HOUR, examples, forecasts, hourly, raw_regimes, scored
from tidegauge.session import materialised, shared_dir
from tidegauge.sources import scenarios
from tidegauge.sources.ledger import Ledger
from tidegauge.streaming import drivers, resolution

X = ("x_ma", "x_ewma", "x_trend")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).filter("arm = 'persistence'").select("signal", "ts_target", "abs_error")


def drift_page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(replay.drift(_errors(spark, sf_dir), "page_hinkley"), ["statistic"])


#: Persistence errors of each signal in order, numbered from 1.
ERRORS_SQL = f"""{BASE}, e AS (SELECT signal, ts_target, abs_error AS x, row_number() OVER (PARTITION BY signal ORDER BY ts_target) AS n FROM scored WHERE arm = 'persistence')"""
PAGE_HINKLEY_SQL = f"""WITH RECURSIVE {ERRORS_SQL},
t(signal, n, ts_target, seen, mean, square, deviation, total, low, rise, alarm, event, last) AS (
  SELECT DISTINCT signal, 0::BIGINT, NULL::DOUBLE, 0, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false, false, NULL::DOUBLE FROM e
  UNION ALL
  SELECT signal, n, ts_target,
    CASE WHEN alarm THEN 0 WHEN deviation IS NULL THEN seen + 1 ELSE seen END, CASE WHEN alarm THEN 0 WHEN deviation IS NULL THEN mean1 ELSE mean END, CASE WHEN alarm THEN 0 WHEN deviation IS NULL THEN square1 ELSE square END,
    CASE WHEN alarm THEN NULL WHEN deviation IS NULL AND seen + 1 >= 60 THEN greatest(sqrt(square1 / seen), 1e-3, 0.01 * abs(mean1)) ELSE deviation END,
    CASE WHEN alarm THEN 0 ELSE total1 END, CASE WHEN alarm THEN 0 ELSE low1 END, total1 - low1, alarm, alarm AND (last IS NULL OR ts_target - last >= 300),
    CASE WHEN alarm AND (last IS NULL OR ts_target - last >= 300) THEN ts_target ELSE last END
  FROM (SELECT *, deviation IS NOT NULL AND total1 - low1 > 25 AS alarm FROM (SELECT *, least(low, total1) AS low1 FROM (
    SELECT t.signal, e.n, e.ts_target, t.seen, t.mean, t.square, t.deviation, t.low, t.last, t.mean + (e.x - t.mean) / (t.seen + 1) AS mean1,
      t.square + (e.x - t.mean) * (e.x - (t.mean + (e.x - t.mean) / (t.seen + 1))) AS square1, CASE WHEN t.deviation IS NULL THEN t.total ELSE t.total + (e.x - t.mean) / t.deviation - 0.5 END AS total1
    FROM t JOIN e ON e.signal = t.signal AND e.n = t.n + 1))))
SELECT signal, ts_target, round(CASE WHEN alarm THEN rise ELSE total - low END, 6) AS statistic, alarm, event FROM t WHERE n > 0"""


#: Errors of a block in ``page_hinkley_in_blocks``.
ERRORS_A_BLOCK = 256


def page_hinkley_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alarms with each scope in many tasks."""
    return rounded(scan.drift(_errors(spark, sf_dir), block_rows=ERRORS_A_BLOCK)[0], ["statistic"])


def drift_adwin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.drift(_errors(spark, sf_dir), "adwin")


def drift_feature_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.feature_drift(examples(spark, sf_dir), list(X))


def conformal_aci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(replay.adaptive_intervals(_errors(spark, sf_dir)), ["width", "alpha"])


ACI_SQL = f"""WITH RECURSIVE {ERRORS_SQL},
t(signal, n, ts_target, pool, alpha, width, covered) AS (
  SELECT DISTINCT signal, 0::BIGINT, NULL::DOUBLE, []::DOUBLE[], 0.1::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN FROM e
  UNION ALL
  SELECT signal, n, ts_target, list_append(pool, x)[-400:], CASE WHEN width IS NULL THEN alpha ELSE least(greatest(alpha + 0.02 * (0.1 - CASE WHEN x <= width THEN 0 ELSE 1 END), 1e-4), 0.999) END, width, x <= width
  FROM (SELECT *, CASE WHEN len(pool) >= 30 THEN s[lo + 1] + (h - lo) * (s[least(lo + 2, len(s))] - s[lo + 1]) END AS width FROM (SELECT *, floor(h)::BIGINT AS lo FROM (
    SELECT t.signal, e.n, e.ts_target, e.x, t.pool, t.alpha, list_sort(t.pool) AS s, (len(t.pool) - 1) * least(greatest(1 - t.alpha, 0), 1) AS h FROM t JOIN e ON e.signal = t.signal AND e.n = t.n + 1))))
SELECT signal, ts_target, round(width, 6) AS width, covered, round(alpha, 6) AS alpha FROM t WHERE n > 0"""


def _regression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).withColumn("one", F.lit(1.0))


def rls_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(replay.online_regression(_regression_rows(spark, sf_dir), ["one", *X], "y", forgetting=0.999), ["predicted", "y"])


def rls_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same forecasts with each scope in many tasks."""
    found, _ = scan.online_regression(_regression_rows(spark, sf_dir), ["one", *X], "y", forgetting=0.999, block_rows=EXAMPLES_A_BLOCK)
    return rounded(found, ["predicted", "y"])


#: Examples of a block in ``rls_in_blocks``: few, so that the small tables have several blocks too.
EXAMPLES_A_BLOCK = 128


def replay_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same forecasts in two runs: models stored as a version halfway through each scope's time, read again and gone on from."""
    rows = _regression_rows(spark, sf_dir).select("signal", "ts_target", "one", *X, "y")
    ends = rows.agg(F.min("ts_target").alias("low"), F.max("ts_target").alias("high")).first()
    cut = 0.0 if ends.low is None else (ends.low + ends.high) / 2
    fit = lambda part, start: replay.resumed_regression(part, ["one", *X], "y", forgetting=0.999, start=start)
    early, kept, _ = fit(rows.filter(F.col("ts_target") < cut), None)
    path = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    states.save(kept, path, 1)
    late, _, _ = fit(rows.filter(F.col("ts_target") >= cut), states.load(spark, path))
    return rounded(early.unionByName(late), ["predicted", "y"])


_D = range(1, 5)
_AT = lambda i, j: 4 * (i - 1) + j
RLS_SQL = f"""WITH RECURSIVE {EXAMPLES_SQL}, e AS (SELECT signal, ts_target, y, [1.0, x_ma, x_ewma, x_trend]::DOUBLE[] AS x, row_number() OVER (PARTITION BY signal ORDER BY ts_target) AS n FROM examples),
t(signal, n, ts_target, predicted, y, w, p) AS (
  SELECT DISTINCT signal, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, [0, 0, 0, 0]::DOUBLE[], [{', '.join('1' if i == j else '0' for i in _D for j in _D)}]::DOUBLE[] FROM e
  UNION ALL
  SELECT signal, n, ts_target, predicted, y, w, CASE WHEN {' + '.join(f'q[{_AT(i, i)}]' for i in _D)} > 40000 THEN list_transform(q, lambda v: v * 40000 / ({' + '.join(f'q[{_AT(i, i)}]' for i in _D)})) ELSE q END
  FROM (SELECT signal, n, ts_target, predicted, y, [{', '.join(f'w[{i}] + px[{i}] / scale * (y - predicted)' for i in _D)}] AS w, [{', '.join(f'(p[{_AT(i, j)}] - px[{i}] * px[{j}] / scale) / 0.999' for i in _D for j in _D)}] AS q
    FROM (SELECT *, 0.999 + list_dot_product(x, px) AS scale, list_dot_product(w, x) AS predicted
      FROM (SELECT t.signal, e.n, e.ts_target, e.y, e.x, t.w, t.p, [{', '.join(f'list_dot_product(t.p[{_AT(i, 1)}:{_AT(i, 4)}], e.x)' for i in _D)}] AS px FROM t JOIN e ON e.signal = t.signal AND e.n = t.n + 1))))
SELECT signal, ts_target, round(predicted, 6) + 0.0 AS predicted, round(y, 6) + 0.0 AS y FROM t WHERE n > 0"""


TIME = ("sin_day", "cos_day", "weekend")


def _learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with time features and the tick's regime."""
    rows = examples(spark, sf_dir)
    timed = rows.select("*", *[c for c, n in zip(features.time_features("ts"), ("sin_day", "cos_day", "sin_week", "cos_week", "weekend"), strict=True) if n in TIME])
    return timed.join(raw_regimes(spark, sf_dir).withColumnRenamed("raw", "regime"), "k", "left")


def _adapted(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    alarms = drift_page_hinkley(spark, sf_dir).filter("event")
    return replay.adaptation(_learnable(spark, sf_dir), [*X, *TIME], X, drifts=alarms, **options)


def adaptation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapted(spark, sf_dir, arms=("online_periodic_drift",))


#: Held-out forecasts under which an arm's accuracy of a scope is not to be relied on.
LEAST_HELD_OUT = 200


def experiment_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out accuracy of every arm of the experiment and of persistence on the same rows, with skill, and whether there are enough of them."""
    learned = materialised(_adapted(spark, sf_dir).filter("held_out AND predicted IS NOT NULL").select("arm", "signal", "ts_target", "predicted", "actual"), "arms")
    # Persistence is scored on the rows that every arm forecast.
    common = learned.groupBy("signal", "ts_target").agg(F.count("*").alias("n")).filter(F.col("n") == len(replay.ARMS)).drop("n")
    naive = examples(spark, sf_dir).join(common, ["signal", "ts_target"], "left_semi").select(F.lit("persistence").alias("arm"), "signal", "ts_target", F.col("persistence").alias("predicted"), "actual")
    both = learned.join(common, ["signal", "ts_target"], "left_semi").unionByName(naive)
    both = both.withColumns({"error": F.col("predicted") - F.col("actual"), "abs_error": F.abs(F.col("predicted") - F.col("actual"))})
    return reports.with_skill(reports.metrics(both, ["arm", "signal"]), ["signal"]).withColumn("enough", F.col("n") >= LEAST_HELD_OUT)


def experiment_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five suites from one replay of their arms: held-out accuracy and skill over all, by regime and over four spans of time."""
    alarms = drift_page_hinkley(spark, sf_dir).filter("event")
    found = experiments.run(_learnable(spark, sf_dir), hourly(spark, sf_dir), [*X, *TIME], X, drifts=alarms)
    return found.select("suite", "arm", "part", "slice", "signal", "n", "mae", "rmse", "bias", "skill")


def warmed_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning loop whose inputs are scaled first: no forecast before 120 inputs; each adaptation's log with gate size, errors before and after, floor and reason."""
    return _adapted(spark, sf_dir, arms=("online_periodic_drift",), warmup=120, every=60, gate=40)


def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each arm's adaptations ended, and why."""
    return _adapted(spark, sf_dir).filter("decision IS NOT NULL").groupBy("arm", "trigger", "decision", "reason").agg(F.count("*").alias("n"))


def streaming_page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift detector over a stream of the errors, read and written in the shared folder."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    errors = _errors(spark, sf_dir)
    errors.repartition("signal").sortWithinPartitions("ts_target").write.parquet(f"{root}/in")
    stream = drivers.drift(spark.readStream.schema(errors.schema).parquet(f"{root}/in"))
    return rounded(drivers.run_once(stream, f"{root}/out", f"{root}/check"), ["statistic"])


def resolve_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts resolved by the streaming operator, results kept by the ledger: events arrive in two parts, shuffled within a part, and the stream starts again from its checkpoint for the second."""
    root = f"{shared_dir(spark)}/resolve-{uuid.uuid4().hex}"
    made = forecasts(spark, sf_dir).select("signal", F.col("k").alias("id"), "ts", "ts_target")
    rows = materialised(resolution.events(made, hourly(spark, sf_dir)), "events")
    ends = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    ledger = Ledger(spark, f"{root}/out", {"resolved": ("signal", "id")})
    if ends.low is None:
        return spark.createDataFrame([], "signal string, k long, actual double, resolved_ts double")
    # A last event, of no signal, lets the watermark pass all.
    clock = spark.range(1).select(
        F.timestamp_seconds(F.lit(ends.high + 30 * 86400)).alias("at"), F.lit("").alias("signal"), F.lit("clock").alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(ends.high).alias("ts"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("ts_target"))
    cut = (ends.low + ends.high) / 2
    resolution.with_timers(spark)
    for part in (rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut).unionByName(clock)):
        part.repartition(F.xxhash64("signal", "kind", "ts")).write.mode("append").parquet(f"{root}/in")
        stream = resolution.resolve(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), HOUR, "12 hours", 60 * 86400.0)
        query = stream.writeStream.foreachBatch(ledger.sink("resolve", lambda batch: {"resolved": batch})).option("checkpointLocation", f"{root}/check")
        query.trigger(availableNow=True).start().awaitTermination()
    return rounded(ledger.read("resolved").select("signal", F.col("id").alias("k"), "actual", "resolved_ts"), ["actual"])


def scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline accuracy on the made-up scenarios: cpu, five minutes ahead."""
    parts = [scenarios.scenario(spark, name) for name in scenarios.SCENARIOS]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    cpu = rows.filter("signal = 'cpu.util_pct'").select(F.col("scenario").alias("signal"), F.col("tick").alias("k"), "ts", "value")
    made = baselines.forecasts(cpu, 300, 300, 120, 0, 100)
    scored_ = baselines.scored(baselines.resolve(made, cpu, scenarios.INTERVAL))
    return reports.with_skill(reports.metrics(scored_, ["arm", "signal"]), ["signal"])


QUERIES = {f.__name__: f for f in (resolve_stream, streaming_page_hinkley, scenario_metrics, drift_page_hinkley, page_hinkley_in_blocks, drift_adwin, drift_feature_shift, conformal_aci, rls_online, rls_in_blocks, replay_resumed, warmed_adaptation, adaptation_replay, experiment_core, experiment_suites, gate_reasons)}
SQL = {"resolve_stream": f"WITH {BASE} SELECT signal, k, round(actual, 6) + 0.0 AS actual, resolved_ts FROM resolved WHERE resolved_ts IS NOT NULL", "page_hinkley_in_blocks": PAGE_HINKLEY_SQL, "streaming_page_hinkley": PAGE_HINKLEY_SQL, "drift_page_hinkley": PAGE_HINKLEY_SQL, "conformal_aci": ACI_SQL, "rls_online": RLS_SQL, "rls_in_blocks": RLS_SQL, "replay_resumed": RLS_SQL}
