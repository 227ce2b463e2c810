"""Answers out of facts: clauses, their order by intent, the reply that is served, and the persona that feedback makes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import answers

#: The clauses of an answer to each intent, in their order.
ORDERS = {
    "battery": ("now", "battery", "forecast", "driver", "rule"),
    "why_change": ("now", "change", "driver", "history", "rule", "forecast"),
    "forecast": ("now", "forecast", "change", "rule"),
    "forecast_error": ("accuracy", "now", "event"),
    "anomaly": ("event", "now", "change", "rule"),
    "adaptation": ("event", "accuracy"),
    "trend": ("now", "change", "driver", "history", "forecast"),
    "status": ("now", "change", "forecast", "rule"),
}


def one_decimal(value: Column, unit: str = "") -> Column:
    """The value with one decimal and its unit, ``n/a`` for none or one that is not finite."""
    return F.when(F.abs(value) < float("inf"), F.concat(F.format_string("%.1f", value), F.lit(unit))).otherwise("n/a")


def duration(seconds: Column) -> Column:
    """A length of time in seconds, minutes, hours or days, by its size."""
    s = F.abs(seconds)
    return (F.when(s < 90, F.format_string("%.0f s", s)).when(s < 5_400, F.format_string("%.0f min", s / 60))
            .when(s < 172_800, F.format_string("%.1f h", s / 3_600)).otherwise(F.format_string("%.1f days", s / 86_400)))


def _text(label: Column | str) -> Column:
    return label if isinstance(label, Column) else F.lit(label)


def now_clause(label: Column | str, value: Column, unit: str = "") -> Column:
    return F.when(value.isNotNull(), F.concat(_text(label), F.lit(" is "), one_decimal(value, unit), F.lit(" now.")))


def change_clause(change: Column, seconds: float, unit: str = "") -> Column:
    way = F.when(change > 0, "up").otherwise("down")
    return F.when(change.isNotNull(), F.concat(F.lit("It went "), way, F.lit(" by "), one_decimal(F.abs(change), unit), F.lit(" in "), duration(F.lit(seconds)), F.lit(".")))


def forecast_clause(label: Column | str, horizon: Column | float, value: Column, lo: Column | None = None, hi: Column | None = None, unit: str = "") -> Column:
    """A forecast always names its signal, so that it can't be taken for another's; a range where there is one."""
    none = F.lit(", a range is not known yet")
    span = none if lo is None or hi is None else F.when(lo.isNotNull() & hi.isNotNull(), F.concat(F.lit(", likely "), one_decimal(lo, unit), F.lit(" to "), one_decimal(hi, unit))).otherwise(none)
    return F.when(value.isNotNull(), F.concat(_text(label), F.lit(" is expected at "), one_decimal(value, unit), F.lit(" in "), duration(horizon if isinstance(horizon, Column) else F.lit(horizon)), span, F.lit(".")))


def driver_clause(label: Column, r: Column, lag_s: Column) -> Column:
    """The strongest driver; never as a cause."""
    ahead = F.when(lag_s >= 15, F.concat(F.lit(", ahead by "), duration(lag_s))).otherwise("")
    return F.when(label.isNotNull(), F.concat(F.lit("Most correlated with it is "), label, F.format_string(" (r=%+.2f)", r), ahead, F.lit(".")))


def battery_clause(plugged: Column, rate: Column, minutes: Mapping[int, Column]) -> Column:
    """Time until the first level of ``minutes`` that has one; on AC power none, and without a projection the rate alone."""
    wait = F.coalesce(*[F.when(m.isNotNull(), F.format_string(f"At this rate about %.0f minutes are left until {level}%%.", m)) for level, m in minutes.items()])
    slow = F.when(rate.isNotNull(), F.format_string("It discharges at %.3f%%/min, too briefly for a projection.", F.abs(rate)))
    return F.when(plugged > 0.5, "It is on AC power and does not discharge.").otherwise(F.coalesce(wait, slow))


def assembled(intent: Column, clauses: Mapping[str, Column], fallback: Column, sentences: Column | int = 4, note: Column | None = None, vocabulary: Mapping[str, str] | None = None) -> Column:
    """The answer to an intent: its clauses in order, at most ``sentences`` of them.

    A null clause is left out. The user's rule is a promise and takes the place
    of the last clause rather than falling to the limit. ``fallback`` answers
    where there is no clause, ``note`` fills free room.
    """
    budget = F.greatest(F.lit(1), F.lit(sentences) if isinstance(sentences, int) else sentences)
    none = F.lit(None).cast("string")
    of = lambda name: clauses.get(name, none)

    def answer(order: tuple[str, ...]) -> Column:
        rule = of("rule") if "rule" in order else none
        parts = F.array(*[of(c) for c in order if c != "rule"])
        room = budget - rule.isNotNull().cast("int")
        said = F.when(room < 1, F.array_compact(F.slice(parts, 1, 1))).otherwise(F.slice(F.array_compact(parts), F.lit(1), F.greatest(room, F.lit(1))))
        return F.array_compact(F.concat(said, F.array(rule)))

    chosen = F.when(intent == "battery", answer(ORDERS["battery"]))
    for name, order in ORDERS.items():
        if name not in ("battery", "status"):
            chosen = chosen.when(intent == name, answer(order))
    chosen = chosen.otherwise(answer(ORDERS["status"]))
    chosen = F.when(F.size(chosen) == 0, F.array(fallback)).otherwise(chosen)
    if note is not None:
        chosen = F.when((F.size(chosen) < budget) & note.isNotNull(), F.concat(chosen, F.array(note))).otherwise(chosen)
    text = F.array_join(F.slice(chosen, F.lit(1), budget), " ")
    for bad, good in (vocabulary or {}).items():
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def served(generated: Column | str, rendered: Column | str, surface: Column) -> tuple[Column, Column, Column]:
    """(text, reason, groundedness) of a reply: what a model said if each of its numbers stands for a fact, else the rendered answer and why."""
    generated, rendered = (F.col(c) if isinstance(c, str) else c for c in (generated, rendered))
    text = answers.stripped(generated)
    said = answers.numbers(text)
    held = answers.grounded(said, surface)
    reason = F.when(F.coalesce(text, F.lit("")) == "", "empty_generation").when(held < F.size(said), "ungrounded_numbers")
    share = F.when(reason == "empty_generation", 1.0).when(F.size(said) > 0, held / F.size(said)).otherwise(1.0)
    return F.when(reason.isNull(), text).otherwise(rendered), reason, share


def persona(feedback: DataFrame, limit: int = 200, sentences: int = 4) -> DataFrame:
    """One row: rules, context, useful, useless, sentences, revision, of the ``limit`` newest rows of feedback (id, ts, kind, text, label).

    A label or note gives a rule or, where it states none, context; repeated
    ones count once, at their first mention. Verdicts on forecasts change how
    many sentences an answer may have.
    """
    rows = feedback.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    text = answers.stripped("text")
    told = F.col("kind").isin("label", "note") & (text != "")
    kinds = rows.select(F.struct("ts", "id").alias("at"), "kind", F.when(told, answers.inferred_rule("text")).alias("rule"), F.when(told, text).alias("said"), F.lower(F.trim("label")).alias("verdict"))
    listed = kinds.agg(
        F.array_sort(F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("at", "rule")))).alias("r"),
        F.array_sort(F.collect_list(F.when(F.col("rule").isNull() & F.col("said").isNotNull(), F.struct("at", "said")))).alias("c"),
        F.count_if((F.col("kind") == "forecast_useful") & F.coalesce(F.col("verdict").isin("yes", "true", "1", "useful"), F.lit(False))).alias("useful"),
        F.count_if(F.col("kind") == "forecast_useful").alias("asked"))
    made = listed.select(F.array_distinct(F.transform("r", lambda x: x["rule"])).alias("rules"), F.array_distinct(F.transform("c", lambda x: x["said"])).alias("context"), "useful", (F.col("asked") - F.col("useful")).alias("useless"))
    allowed = made.withColumn("sentences", answers.verbosity(F.col("useful"), F.col("useless"), F.lit(sentences)))
    moved = ((F.col("useless") > F.col("useful") + 2) | (F.col("useful") > F.col("useless") + 4)).cast("int")
    return allowed.withColumn("revision", F.size("rules") + F.size("context") + moved)
