"""Batch drivers of the sequential kernels: one group of a scope, in time order.

State is per key, so parallelism is over runs, arms and scopes. A scope's rows
stream through its task in order and only the kernel is held, so a long scope
does not have to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import states
from tidegauge.operators.sequential import AdaptiveInterval, AdaptiveWindow, Cooldown, FeatureShift, Hysteresis, PageHinkley, RecursiveLeastSquares, ScopeLearner
from tidegauge.session import materialised, ship


def _in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a key together and in order, in one partition each."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def stepped(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], make: Callable[[tuple], object], step: Callable[[object, dict], tuple], schema: str) -> DataFrame:
    """Run a kernel over each key's rows in order.

    Rows stream through the task batch by batch; only the kernel of the key at
    hand is held. ``make`` builds it from the key, ``step`` gives the output
    values of a row, which follow the keys and ``columns`` in ``schema``.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kernel = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mine = tuple(row[k] for k in keys)
                if kernel is None or mine != key:
                    key, kernel = mine, make(mine)
                out.append((*mine, *(row[c] for c in columns), *step(kernel, row)))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], schema=_arrow(schema))

    ship(rows.sparkSession)
    return _in_order(rows, keys, order).mapInArrow(run, schema)


def resumable(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], make: Callable[[tuple], object], step: Callable[[object, dict], tuple], schema: str, start: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``stepped``, from stored states: (the rows' results; keys and ``state`` after each key's last row; keys and ``problem``).

    ``start`` has keys and ``state`` (one row a key). A key without a state
    starts afresh, and so does one whose state cannot be used, which is reported
    in the problems. A key with a state but no rows keeps its state.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    whole = f"{schema}, _kind string, _text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kernel, held = None, None, []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(held, schema=_arrow(whole))

        def aside(kind: str, text: str) -> dict:
            return dict(zip(keys, key, strict=True)) | {"_kind": kind, "_text": text}

        for batch in batches:
            for row in batch.to_pylist():
                mine = tuple(row[k] for k in keys)
                if kernel is None or mine != key:
                    if kernel is not None:
                        held.append(aside("state", states.encode(kernel)))
                    key, kernel = mine, make(mine)
                if row["_state"] is not None:
                    try:
                        kernel = states.decode(row["_state"], kernel)
                    except states.StateError as error:
                        held.append(aside("problem", str(error)))
                    continue
                out = (*mine, *(row[c] for c in columns), *step(kernel, row))
                held.append(dict(zip(names, out, strict=True)) | {"_kind": "row"})
            if held:
                yield sent()
                held = []
        if kernel is not None:
            held.append(aside("state", states.encode(kernel)))
            yield sent()

    dealt = rows.withColumn("_state", F.lit(None).cast("string"))
    if start is not None:
        dealt = dealt.unionByName(start.select(*keys, F.col("state").alias("_state")), allowMissingColumns=True)
    ship(rows.sparkSession)
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, F.col("_state").isNull(), *order)
    found = materialised(ordered.mapInArrow(run, whole), "resumed")
    aside_rows = lambda kind, name: found.filter(F.col("_kind") == kind).select(*keys, F.col("_text").alias(name))
    return found.filter("_kind = 'row'").select(names), aside_rows("state", "state"), aside_rows("problem", "problem")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def drift(errors: DataFrame, detector: str, keys: Sequence[str] = ("signal",), order: str = "ts_target", value: str = "abs_error", cooldown: float = 300.0) -> DataFrame:
    """(signal, ts_target, statistic, alarm, event) of a detector over each scope's errors; ``event`` is an alarm outside the cooldown."""
    kinds = {"page_hinkley": PageHinkley, "adwin": AdaptiveWindow}

    def step(state: tuple, row: dict) -> tuple:
        alarm, statistic = state[0].step(row[value])
        return statistic, alarm, alarm and state[1].step("error", row[order])

    return stepped(errors.select(*keys, order, value), keys, [order], [order], lambda _: (kinds[detector](), Cooldown(cooldown)), step,
                   ", ".join([*(f"{k} string" for k in keys), f"{order} double", "statistic double", "alarm boolean", "event boolean"]))


def feature_drift(rows: DataFrame, features: Sequence[str], key: str = "signal", order: str = "ts", window: int = 120, threshold: float = 4.0, cooldown: float = 300.0) -> DataFrame:
    """(signal, ts, statistic, alarm, feature, event) of the feature-shift detector; ``event`` is an alarm outside the cooldown, which all features share."""

    def step(state: tuple, row: dict) -> tuple:
        alarm, shift, at = state[0].step(np.array([row[f] if row[f] is not None else 0.0 for f in features]))
        return shift, alarm, features[at] if at >= 0 else None, alarm and state[1].step("feature", row[order])

    return stepped(rows.select(key, order, *features), [key], [order], [order], lambda _: (FeatureShift(window, threshold), Cooldown(cooldown)), step,
                   f"{key} string, {order} double, statistic double, alarm boolean, feature string, event boolean")


def adaptive_intervals(scored: DataFrame, key: str = "signal", order: str = "ts_target", alpha: float = 0.1, rate: float = 0.02, pool: int = 400, least: int = 30) -> DataFrame:
    """(signal, ts_target, width, covered, alpha): the interval each forecast had, and the share after its outcome."""

    def step(state: AdaptiveInterval, row: dict) -> tuple:
        width = state.width()
        covered = None if width is None else row["abs_error"] <= width
        state.step(row["abs_error"], covered)
        return width, covered, state.alpha

    return stepped(scored.select(key, order, "abs_error"), [key], [order], [order], lambda _: AdaptiveInterval(alpha, rate, pool, least), step, f"{key} string, {order} double, width double, covered boolean, alpha double")


def resumed_regression(examples: DataFrame, x: Sequence[str], y: str, key: str = "signal", order: str = "ts_target", ridge: float = 1.0, forgetting: float = 1.0, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``online_regression`` from stored models: (rows, states after them, problems)."""
    return resumable(*_regression(examples, x, y, key, order, ridge, forgetting), start=start)


def online_regression(examples: DataFrame, x: Sequence[str], y: str, key: str = "signal", order: str = "ts_target", ridge: float = 1.0, forgetting: float = 1.0) -> DataFrame:
    """(signal, ts_target, predicted, y): what the model said before it learned each row."""
    return stepped(*_regression(examples, x, y, key, order, ridge, forgetting))


def _regression(examples: DataFrame, x: Sequence[str], y: str, key: str, order: str, ridge: float, forgetting: float) -> tuple:
    def step(state: RecursiveLeastSquares, row: dict) -> tuple:
        v = np.array([row[c] for c in x], float)
        said = state.predict(v)
        state.step(v, row[y])
        return said, row[y]

    return examples.select(key, order, *x, y), [key], [order], [order], lambda _: RecursiveLeastSquares(len(x), ridge, forgetting), step, f"{key} string, {order} double, predicted double, y double"


#: Arms of the experiment: what each changes about the learner.
ARMS: dict[str, dict] = {
    "static": {"policies": ("periodic_samples",), "every": 60, "freeze": True}, "online_periodic": {"policies": ("periodic_samples",)}, "online_drift": {"policies": ("drift",)},
    "online_periodic_drift": {}, "online_no_gate": {"gated": False}, "per_regime": {"per_regime": True}, "no_trust_region": {"trust": 1e6}, "trust_region_correction": {"correct_only": True},
    "no_baseline_features": {"blind": True},
}


def adaptation(
    examples: DataFrame, x: Sequence[str], baseline_x: Sequence[str] = (), arms: Sequence[str] = tuple(ARMS), lo: float = 0.0, hi: float = 200.0, train_share: float = 0.5, every: int = 240, gate: int = 120,
    drifts: DataFrame | None = None, warmup: int = 0, boundary: DataFrame | None = None,
) -> DataFrame:
    """(arm, signal, ts_target, predicted, width, actual, decision, reason, trigger, version, held_out, and of each adaptation gate_n, n_train, metric_before, metric_after, floor) of the learning loop, every arm on the same rows.

    ``examples`` has signal, ts, ts_target, anchor, vol, actual, ``x`` (of which
    ``baseline_x`` are the baselines' inputs) and, for arms by regime, regime.
    Each arm and scope is a group of its own; drift alarms, which do not depend
    on the learner, come in as rows of ``drifts`` (signal, ts_target). ``boundary``
    (signal, boundary) says where the held-out part begins, unless at each signal's own share.
    """
    return stepped(*_adaptation(examples, x, baseline_x, arms, lo, hi, train_share, every, gate, drifts, warmup, boundary)).filter("event = 0").drop("event")


def resumed_adaptation(
    examples: DataFrame, x: Sequence[str], baseline_x: Sequence[str] = (), arms: Sequence[str] = tuple(ARMS), lo: float = 0.0, hi: float = 200.0, train_share: float = 0.5, every: int = 240, gate: int = 120,
    drifts: DataFrame | None = None, warmup: int = 0, boundary: DataFrame | None = None, between: tuple[float, float] = (float("-inf"), float("inf")), start: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``adaptation`` of the events from ``between[0]`` to before ``between[1]``, from stored learners: (rows, states after them, problems).

    ``boundary`` (signal, boundary) says where each signal's held-out part
    begins; unless given it is taken from ``examples``, so either give it or give
    all examples every time.
    """
    rows, *rest = _adaptation(examples, x, baseline_x, arms, lo, hi, train_share, every, gate, drifts, warmup, boundary)
    found, states_, problems = resumable(rows.filter((F.col("at") >= between[0]) & (F.col("at") < between[1])), *rest, start=start)
    return found.filter("event = 0").drop("event"), states_, problems


def _adaptation(examples, x, baseline_x, arms, lo, hi, train_share, every, gate, drifts, warmup, boundary) -> tuple:
    bounds = boundary if boundary is not None else examples.groupBy("signal").agg(F.percentile("ts", train_share).alias("boundary"))
    regime = F.col("regime") if "regime" in examples.columns else F.lit("*")
    rows = examples.select("signal", "ts", "ts_target", "anchor", "vol", "actual", regime.alias("regime"), *x).join(bounds, "signal")
    alarms = drifts.select("signal", "ts_target", F.lit(True).alias("drift")).distinct() if drifts is not None else None
    rows = rows.join(alarms, ["signal", "ts_target"], "left") if alarms is not None else rows.withColumn("drift", F.lit(None).cast("boolean"))
    rows = rows.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    # Within one time an outcome comes before the prediction made then.
    made = rows.withColumns({"at": F.col("ts"), "event": F.lit(1)})
    come = rows.withColumns({"at": F.col("ts_target"), "event": F.lit(0)})
    baselines = tuple(1 + list(x).index(c) for c in baseline_x)

    def make(key: tuple) -> dict:
        options = dict(ARMS[key[0]])
        return {"freeze": options.pop("freeze", False), "blind": options.pop("blind", False), "options": {"every": every} | options, "learner": None, "scope": f"{key[1]}", "open": {}, "d": RecursiveLeastSquares(len(x) + 1)}

    def step(state: dict, row: dict) -> tuple:
        if state["learner"] is None:
            state["learner"] = ScopeLearner(len(x) + 1, state["scope"], gate=gate, frozen_after=row["boundary"] if state["freeze"] else float("inf"), lo=lo, hi=hi, baselines=baselines, warmup=warmup, **state["options"])
        learner = state["learner"]
        e = {"x": np.array([1.0, *(row[c] for c in x)], float), "anchor": row["anchor"], "vol": row["vol"], "actual": row["actual"], "ts_target": row["ts_target"], "regime": row["regime"]}
        if state["blind"]:
            e["x"][list(baselines)] = 0.0
        if row["event"] == 1:
            state["open"][row["ts_target"]] = learner.predict(e)
            return (None,) * 13
        said = state["open"].pop(row["ts_target"], None)
        learner.drifted = learner.drifted or bool(row["drift"])
        decision = learner.outcome(e, said, row["ts_target"])
        log = learner.log if decision else {}
        return (said[0] if said else None, said[1] if said else None, row["actual"], decision, learner.reason, learner.trigger, learner.version, row["ts_target"] >= row["boundary"],
                log.get("gate_n"), log.get("n_train"), log.get("before"), log.get("after"), learner.floor if log.get("n_train") else None)

    schema = "arm string, signal string, ts_target double, event int, predicted double, width double, actual double, decision string, reason string, trigger string, version int, held_out boolean, gate_n int, n_train int, metric_before double, metric_after double, floor double"
    return made.unionByName(come), ["arm", "signal"], ["at", "event", "ts_target"], ["ts_target", "event"], make, step, schema


def settled(rows: DataFrame, key: str = "run", order: str = "k", raw: str = "raw", needed: int = 3) -> DataFrame:
    """(run, k, raw, regime): hysteresis in its keyed form, exact with ``unknown`` labels too."""
    return stepped(rows.select(key, order, raw), [key], [order], [order, raw], lambda _: Hysteresis(needed), lambda state, row: (state.step(row[raw]),), f"{key} string, {order} long, {raw} string, regime string")
