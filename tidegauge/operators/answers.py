"""Checks of questions and answers: intent, focus, numbers, grounding, style, rules out of notes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(low: Column, phrases: Sequence[str]) -> Column:
    found = low.contains(phrases[0])
    for p in phrases[1:]:
        found = found | low.contains(p)
    return found


def first_label(low: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None) -> Column:
    """The label of the first rule with a phrase in the lower-cased text."""
    out = F.when(contains_any(low, rules[0][1]), rules[0][0])
    for label, phrases in rules[1:]:
        out = out.when(contains_any(low, phrases), label)
    return out.otherwise(F.lit(default))


#: Intents in the order they are tried, with the phrases that give them.
INTENTS = (
    ("forecast_error", ("forecast wrong", "prediction wrong", "was wrong", "inaccurate", "off by", "mispredict", "bad forecast", "accuracy", "how accurate", "forecast was")),
    ("battery", ("battery", "charge", "unplug", "plugged", "power last", "last another", "run out", "discharge")),
    ("why_change", ("why", "cause", "because", "reason", "what made", "driving", "responsible")),
    ("anomaly", ("unusual", "weird", "strange", "anomal", "abnormal", "different than", "changed compared", "compared with", "compared to")),
    ("adaptation", ("learn", "adapt", "model", "version", "rollback", "retrain", "improving")),
    ("forecast", ("will", "predict", "forecast", "expect", "next", "going to")),
    ("trend", ("trend", "rising", "falling", "increasing", "decreasing", "climbing", "dropping", "spike")),
)


def intent(text: Column | str) -> Column:
    """The first intent with a phrase in the text, else ``status``."""
    return first_label(F.lower(_col(text)), INTENTS, "status")


#: Words of a question and the signal that they ask for, in the order they are tried.
ALIASES = (
    ("cpu", "cpu.util_pct"), ("processor", "cpu.util_pct"), ("memory", "mem.used_pct"), ("ram", "mem.used_pct"), ("battery", "battery.percent"), ("gpu", "gpu.util_pct"),
    ("temperature", "thermal.cpu_c"), ("temp", "thermal.cpu_c"), ("hot", "thermal.cpu_c"), ("disk", "disk.busy_pct"), ("network", "net.recv_mbps"), ("swap", "mem.swap_used_pct"),
)


def focus(text: Column | str, labels: Mapping[str, str], aliases: Sequence[tuple[str, str]] = ALIASES, available: Sequence[str] | None = None) -> Column:
    """The signal whose label (longest first), or else whose alias, is in the text; null for none. ``labels`` maps signals to labels."""
    known = lambda signal: available is None or signal in available
    rules = [(s, (label.lower(),)) for s, label in sorted(labels.items(), key=lambda p: -len(p[1])) if known(s)]
    rules += [(s, (word,)) for word, s in aliases if known(s)]
    return first_label(F.lower(_col(text)), rules, None) if rules else F.lit(None).cast("string")


#: Fixed value: a number, with a sign, thousands separators and decimals.
NUMBER = r"[-+]?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?|[-+]?[0-9]+(?:\.[0-9]+)?"
#: Where a number starts that belongs to a fixed phrase (top 1, top 3, 1st, 2nd, 3rd, 24/7, v001, v002).
EXEMPT = r"(?:(?<=top )(?=[13])|(?=1st|2nd|3rd|24/7)|(?<=24/)(?=7)|(?<=v)(?=001|002))"


def numbers(text: Column | str) -> Column:
    """Numbers said in a text, thousands separators removed, those of fixed phrases left out."""
    found = F.regexp_extract_all(_col(text), F.lit(f"(?i){EXEMPT}(?:{NUMBER})|({NUMBER})"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def near(said: Column, fact: Column) -> Column:
    """Whether a number said stands for a fact: within max(0.15, 6 % of the fact), signed or by size."""
    tolerance = F.greatest(F.lit(0.15), 0.06 * F.abs(fact))
    return (F.abs(said - fact) <= tolerance) | (F.abs(F.abs(said) - F.abs(fact)) <= tolerance)


def grounded(said: Column, surface: Column) -> Column:
    """How many of the numbers said stand for one of ``surface``; null and non-finite facts support nothing."""
    usable = F.filter(surface, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.size(F.filter(said, lambda s: F.exists(usable, lambda v: near(s, v))))


#: Phrases that assert a cause, hedge it, or state how sure a forecast is.
CAUSAL = ("caused by", "because of", "due to", "is causing", "causes the")
HEDGES = ("correlated", "coincid", "associated", "alongside", "tracks", "moved with", "strongest correlat", "lines up with")
UNCERTAINTY = ("likely", "range", "between", "roughly", "about", "approximately", "around", "estimate", "to ", "+/-", "±")
DURATION = r"[0-9]+(?:\.[0-9]+)?\s*(?:h|hr|hrs|hour|hours|min|mins|minute|minutes)\b"


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def sentence_count(text: Column | str) -> Column:
    """Sentences of a text; a point between digits ends none."""
    whole = F.regexp_replace(stripped(text), r"([0-9])\.([0-9])", "$1<DOT>$2")
    return F.size(F.filter(F.split(whole, r"[.!?]+(?:\s|$)"), lambda p: stripped(p) != ""))


def style_violations(
    text: Column | str, max_sentences: int = 4, lead_with_number: bool = True, forecasts: Column | None = None, projection: Column | None = None, drivers: Column | None = None,
    vocabulary: Mapping[str, str] | None = None, required: Column | None = None,
) -> tuple[Column, Column]:
    """(number of checks, array of violations) of an answer by seven families of checks.

    ``forecasts`` are the forecasts at hand, ``projection`` whether a time to an
    empty battery is known, ``drivers`` whether drivers are, ``required`` the
    words that the user's rules call for. A family without its input makes no check.
    """
    text = _col(text)
    low = F.lower(text)
    no, one = F.lit(False), lambda name, on, bad: (on, F.when(bad, name))
    count = sentence_count(text)
    checks = [one(F.format_string("too_long(%d>%d)", count, F.lit(max_sentences)), F.lit(True), count > max_sentences)]
    if lead_with_number:
        first = F.get(F.split(stripped(text), r"(?<=[.!?])\s", 2), F.lit(0))
        checks.append(one(F.lit("no_number_in_first_sentence"), F.lit(True), ~first.rlike("[0-9]")))
    if forecasts is not None:
        states = F.exists(numbers(text), lambda n: F.exists(forecasts, lambda f: F.abs(n - f) <= F.greatest(F.lit(0.15), 0.06 * F.abs(f))))
        on = F.coalesce(states, no)
        checks.append(one(F.lit("forecast_without_uncertainty"), on, on & ~contains_any(low, UNCERTAINTY)))
    if projection is not None:
        checks.append(one(F.lit("battery_without_duration"), projection, projection & ~low.rlike(DURATION)))
    if drivers is not None:
        checks.append(one(F.lit("asserted_causation"), drivers, drivers & contains_any(low, CAUSAL) & ~contains_any(low, HEDGES)))
    for bad, good in (vocabulary or {}).items():
        checks.append(one(F.lit(f"vocabulary({bad}->{good})"), F.lit(True), low.contains(bad.lower()) & ~low.contains(good.lower())))
    total = sum((on.cast("int") for on, _ in checks[1:]), checks[0][0].cast("int"))
    found = F.array_compact(F.array(*[name for _, name in checks]))
    if required is not None:
        total = total + F.size(required)
        found = F.concat(found, F.transform(F.filter(required, lambda w: (w != "") & ~low.contains(F.lower(w))), lambda w: F.concat(F.lit("missing_rule_word("), w, F.lit(")"))))
    return total, found


#: Regimes that a note hints at, in the order they are tried, and phrases that call something expected or worrying.
REGIME_HINTS = (
    ("build", ("compil", "build", "cargo", "make", "gradle", "webpack", "rustc", "linking")), ("gpu_heavy", ("game", "gaming", "render", "cuda", "train", "inference", "gpu")),
    ("io_heavy", ("backup", "sync", "index", "copy", "download large")), ("battery_constrained", ("unplugged", "on battery", "low battery")),
    ("charging", ("charging", "plugged in")), ("media", ("video", "stream", "movie", "call", "zoom", "meet")),
)
NORMAL = (
    "that's normal", "thats normal", "is normal", "normal for me", "normal for my", "treat that as normal", "expected", "always happens", "happens when i", "on purpose", "deliberate",
    "that's fine", "thats fine", "no problem",
)
CONCERN = ("shouldn't", "should not", "not normal", "unexpected", "problem", "worrying")


def inferred_rule(text: Column | str) -> Column:
    """struct(regime, verdict, note, required_word) of a note that says what is normal or worrying (the latter wins); null for others."""
    text = _col(text)
    low = stripped(F.lower(text))
    verdict = F.when(contains_any(low, CONCERN), "concerning").when(contains_any(low, NORMAL), "normal")
    word = F.when(verdict == "normal", "normal").otherwise("unusual")
    return F.when(verdict.isNotNull(), F.struct(first_label(low, REGIME_HINTS, "*").alias("regime"), verdict.alias("verdict"), F.substring(stripped(text), 1, 160).alias("note"), word.alias("required_word")))


def verbosity(useful: Column, useless: Column, sentences: Column | int) -> Column:
    """Sentences that an answer may have, after feedback: one more (at most 6) or one less (at least 2)."""
    n = F.lit(sentences) if isinstance(sentences, int) else sentences
    return F.when(useless > useful + 2, F.least(F.lit(6), n + 1)).when(useful > useless + 4, F.greatest(F.lit(2), n - 1)).otherwise(n)
