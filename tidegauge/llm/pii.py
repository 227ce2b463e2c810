"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 1).

Base spans follow the four patterns exactly. Around digit runs, at-signs and
spelled-out at-signs a semi-Markov CRF adds what the patterns miss (written
apart, bracketed, without a country code, with other separators): a segment is a
whole candidate span, its features are of the whole span (digit counts, group
lengths, separators, checksum, edges, the word before), a transition score links
it to the kind of the entity before it in its window, and a Viterbi pass over
segments of at most ``MAX_TOKENS`` tokens chooses boundaries and kinds together.
Windows end between words, however long these are.
Base spans are barriers of that pass: they stay, and no segment overlaps one.

The model is trained here: weights maximise the conditional likelihood of
sentences from a seeded generator, by segment forward-backward and gradient
steps. Training is on the driver and the weights, a few hundred numbers, go to
the workers with the function.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidegauge.llm.common import map_arrow, packed, ref, slices, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The state of a segmentation: the kind of its last entity so far, at first none.
STATES = ("none", *KINDS)
_START = [0.0, *[-math.inf] * len(KINDS)]
MAX_TOKENS = 19
MAX_CHARS = 320
#: Digit groups of a segment without an at-sign.
MAX_GROUPS = 8
#: How much likelier than "no entity" a segment must be to be taken.
MARGIN = 2.0

Span = tuple[str, int, int]

# -- base patterns ----------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Possessive forms: what follows a digit run is never a digit, so nothing is lost and long runs take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c)
        if n % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their at-signs so that long runs take linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = max(end, start)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """What the spans cover, as disjoint intervals by start."""
    out: list[tuple[int, int]] = []
    for _, a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def written(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


# -- candidate segments and their features ----------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|[\W_]|\d", re.S)
#: Where a segment may lie: four digits close together, an at-sign, a bracketed or spelled-out at-sign.
_NUMBERS = re.compile(r"[0-9](?:[^0-9A-Za-z\n]{0,3}[0-9]){3,}+")
_AT = re.compile(r"@|[(\[{]\s?(?:at|AT)\s?[)\]}]|\s(?:at|AT)\s(?=\S{1,40}\s?[(\[{]?\s?(?:dot|DOT)\s?[)\]}]?\s?\S)")
_BEFORE, _LOCAL_BEFORE, _AFTER = 48, 96, 320
#: Words that announce a kind.
_CUES = {
    "phone": {"tel", "telephone", "phone", "call", "mobile", "cell", "fax", "ring", "whatsapp"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "cc", "pan"},
    "ip": {"ip", "host", "server", "addr", "address", "node", "from"},
    "email": {"mail", "email", "contact", "write", "reach"},
}
#: Words that announce a number of another kind, and words that stand before "at" in prose.
_OTHER_CUES = {"isbn", "issn", "invoice", "order", "ref", "reference", "no", "serial", "sku", "po", "part", "version", "ticket"}
_PROSE = {"me", "us", "you", "him", "her", "them", "it", "is", "are", "was", "were", "be", "here", "there", "look", "looking", "meet", "stay", "arrive", "and", "or", "not", "only", "just", "all", "one"}
_CUE_OF = {w: k for k, ws in _CUES.items() for w in ws} | dict.fromkeys(_OTHER_CUES, "other")
_ATS = {"@", "at"}


def windows(text: str) -> list[tuple[int, int]]:
    """Disjoint parts of the text where a segment may lie; they begin and end between words."""
    found = [(m.start() - _BEFORE, m.end() + 8) for m in _NUMBERS.finditer(text)] if _DIGIT.search(text) else []
    found += [(m.start() - _LOCAL_BEFORE, m.end() + _AFTER) for m in _AT.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        a, b, low = max(a, 0), min(b, len(text)), out[-1][1] if out else 0
        # No place is passed twice: a window that reaches the one before it joins it.
        while a > low and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        if b > low:
            while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
                b += 1
        if out and a <= low:
            out[-1] = (out[-1][0], max(low, b))
        else:
            out.append((a, b))
    return out


def _bucket(n: int) -> str:
    return str(n) if n < 8 or n in (10, 11, 16) else "8-9" if n < 10 else "12-13" if n < 14 else "14-15" if n < 16 else "17-19"


@lru_cache(maxsize=20_000)
def segment_features(kind: str, span: str, before: str, after: str, cue: str | None) -> list[str]:
    """Whole-span features of a candidate, each named after the kind."""
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    sizes = "-".join(str(len(g)) for g in groups[:6])
    marks = "".join(sorted({"s" if c.isspace() else c for c in span if not c.isalnum()}))
    out = ["bias", f"edge:{before.isalnum()}{after.isalnum()}", f"near:{before in '-.@/:_#$=,'}{after in '-/@:_%'}" if before and after else "near:end",
           f"cue:{cue == kind}", f"other:{cue is not None and cue != kind}"]
    if kind == "email":
        low = span.lower()
        parts = re.split(r"\s*[(\[{]?\s*(?:\bat\b|@)\s*[)\]}]?\s*", low, maxsplit=1)
        host = parts[1] if len(parts) > 1 else ""
        labels = [x for x in re.split(r"\s*[(\[{]?\s*(?:\bdot\b|\.)\s*[)\]}]?\s*", host)]
        tidy = len(labels) > 1 and all(re.fullmatch(r"[a-z0-9-]+", x) for x in labels)
        out += [f"labels:{min(len(labels), 4)}", f"tidy:{tidy}", f"top:{tidy and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 6}",
                f"local:{bool(re.fullmatch(r'[a-z0-9._%+-]+', parts[0]))}", f"prose:{' ' in span and parts[0] in _PROSE}", f"how:{'@' if '@' in span else 'b' if re.search(r'[(\[{]', span) else 'w'}",
                f"dots:{bool(re.search(r'dot', host))}", f"spaced:{' ' in span}"]
    else:
        out += [f"n:{_bucket(len(digits))}", f"groups:{min(len(groups), 6)}", f"marks:{marks[:4]}", f"sizes:{sizes}", f"open:{span[0] if not span[0].isdigit() else 'd'}",
                f"zero:{digits[0] == '0'}", f"one:{len(set(marks)) <= 1}"]
        if kind == "card":
            out += [f"luhn:{luhn(digits)}", f"long:{13 <= len(digits) <= 19}", f"fours:{all(len(g) == 4 for g in groups[:-1])}", f"both:{luhn(digits) and 13 <= len(digits) <= 19}"]
        if kind == "ip":
            out += [f"octets:{len(groups) == 4 and all(int(g) <= 255 for g in groups)}", f"dots:{span.count('.') == 3}"]
        if kind == "phone":
            out += [f"last4:{len(groups[-1]) == 4}", f"area:{len(groups) > 1 and len(groups[0]) in (3, 4)}", f"paren:{'(' in span}", f"date:{bool(re.fullmatch(r'[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}', span))}"]
    return [f"{kind} {f}" for f in out]


class Segments:
    """Candidates of one window: (first token, after its last token, kind, features)."""

    def __init__(self, text: str, start: int, end: int, barriers: list[tuple[int, int]]):
        self.tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text, start, end)]
        self.n = len(self.tokens)
        self.found: list[tuple[int, int, str, list[str]]] = []
        tokens = self.tokens
        blocked, at = [False] * self.n, 0
        for i, (s, e, _) in enumerate(tokens):
            while at < len(barriers) and barriers[at][1] <= s:
                at += 1
            blocked[i] = at < len(barriers) and barriers[at][0] < e
        cue, seen = None, -99
        for i, (s, _, word) in enumerate(tokens):
            if word.lower() in _CUE_OF:
                cue, seen = _CUE_OF[word.lower()], i
                # A cue may itself begin a local part, so no ``continue``.
            if word.isspace() or blocked[i] or not (word[0].isalnum() or word in "(+"):
                continue
            digits = groups = letters = ats = 0
            for j in range(i, min(i + MAX_TOKENS, self.n)):
                _, e, last = tokens[j]
                if blocked[j] or e - s > MAX_CHARS or "\n" in last:
                    break
                if last.isdigit() and last.isascii():
                    digits += len(last)
                    groups += 1
                elif last.isalpha():
                    letters += 1
                    ats += last.lower() == "at"
                ats += last == "@"
                if ats > 1 or (digits > 19 or groups > MAX_GROUPS) and not ats:
                    break
                if not (last[0].isalnum() or last == ")"):
                    continue
                span = text[s:e]
                before, after = text[s - 1 : s], text[e : e + 1]
                near = cue if i - seen <= 6 and seen < i else None
                if not letters and digits >= 4:
                    # A segment starts at a digit group, a bracket before one, or a plus sign, and ends after a digit.
                    if not last.isdigit():
                        continue
                    kinds = [k for k, low, high in (("ip", 4, 12), ("phone", 7, 15), ("card", 13, 19)) if low <= digits <= high]
                    if "ip" in kinds and len(re.findall(r"[0-9]+", span)) != 4:
                        kinds.remove("ip")
                elif ats == 1 and letters > 1 and last[0].isalnum() and word not in "(+" and word.lower() not in _ATS:
                    kinds = ["email"]
                else:
                    continue
                for kind in kinds:
                    self.found.append((i, j + 1, kind, segment_features(kind, span, before, after, near)))

    def scores(self, weights: dict[str, float], margin: float = 0.0) -> list[float]:
        return [sum([weights.get(f, 0.0) for f in features]) - margin for _, _, _, features in self.found]

    def best(self, scores: list[float], moves: list[list[float]]) -> list[int]:
        """Places of the segments of the best segmentation (tokens outside segments score 0 and keep the state)."""
        ending: dict[int, list[int]] = {}
        for at, (_, j, _, _) in enumerate(self.found):
            ending.setdefault(j, []).append(at)
        value, back = [_START], [[None] * len(STATES)]
        for j in range(1, self.n + 1):
            row, origin = list(value[j - 1]), [None] * len(STATES)
            for at in ending.get(j, ()):
                i, _, kind, _ = self.found[at]
                k = STATES.index(kind)
                v, s = max((value[i][s] + moves[s][k], -s) for s in range(len(STATES)))
                if v + scores[at] > row[k]:
                    row[k], origin[k] = v + scores[at], (at, -s)
            value.append(row)
            back.append(origin)
        out, j, state = [], self.n, max(range(len(STATES)), key=lambda s: (value[self.n][s], -s))
        while j > 0:
            if back[j][state] is None:
                j -= 1
            else:
                at, state = back[j][state]
                out.append(at)
                j = self.found[at][0]
        return out[::-1]

    def marginals(self, scores: list[float], moves: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        """(probability of each candidate, expected number of each transition) under the CRF, by forward-backward over segments."""
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for at, (i, j, _, _) in enumerate(self.found):
            ending.setdefault(j, []).append(at)
            starting.setdefault(i, []).append(at)
        every = range(len(STATES))
        ahead, behind = [_START], [[0.0] * len(STATES)] * (self.n + 1)
        for j in range(1, self.n + 1):
            row = list(ahead[j - 1])
            for at in ending.get(j, ()):
                i, _, kind, _ = self.found[at]
                k = STATES.index(kind)
                row[k] = _log_sum([row[k], *(ahead[i][s] + moves[s][k] + scores[at] for s in every)])
            ahead.append(row)
        for i in range(self.n - 1, -1, -1):
            row = list(behind[i + 1])
            for at in starting.get(i, ()):
                _, j, kind, _ = self.found[at]
                k = STATES.index(kind)
                row = [_log_sum([row[s], moves[s][k] + scores[at] + behind[j][k]]) for s in every]
            behind[i] = row
        whole = _log_sum(ahead[self.n])
        chances, expected = [], [[0.0] * len(STATES) for _ in every]
        for at, (i, j, kind, _) in enumerate(self.found):
            k = STATES.index(kind)
            each = [math.exp(min(ahead[i][s] + moves[s][k] + scores[at] + behind[j][k] - whole, 0.0)) for s in every]
            for s in every:
                expected[s][k] += each[s]
            chances.append(sum(each))
        return chances, expected


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values])) if top > -math.inf else top


def transitions(weights: dict[str, float]) -> list[list[float]]:
    """Score of going from each state to each."""
    return [[weights.get(f"move {a}>{b}", 0.0) for b in STATES] for a in STATES]


# -- training ---------------------------------------------------------------------------------------------------------


def _word(r: random.Random) -> str:
    return "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))


def _number(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(r.choice("0123456789") for _ in range(n - 1))


def _card(r: random.Random, n: int) -> str:
    body = r.choice("3456") + _number(r, n - 2)
    return next(body + c for c in "0123456789" if luhn(body + c))


def sentence(r: random.Random) -> tuple[str, list[Span]]:
    """A made-up sentence and the spans of personal data in it."""
    parts: list[tuple[str, str | None]] = []
    for _ in range(r.randint(1, 3)):
        parts += [(_word(r), None) for _ in range(r.randint(1, 5))]
        kind = r.choice([*KINDS, *KINDS, None, None, None, None])
        if kind and r.random() < 0.35:
            parts.append((r.choice(sorted(_CUES[kind])) + r.choice(["", ":"]), None))
        n = lambda k: _number(r, k)
        if kind == "phone":
            a, b, c = n(3), n(3), n(4)
            parts.append((r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{n(2)} {n(3)} {n(6)}", f"0{n(3)} {n(6)}", f"0{n(2)}/{n(7)}", f"+{n(1)}/{a}/{b}/{c}", f"{a} {b} {c}", f"({a}){b}-{c}"]), kind))
        elif kind == "card":
            d = _card(r, r.choice([16, 16, 16, 15, 13]))
            sep = r.choice([".", "/", "_", " - ", "  ", ""]) if len(d) == 16 else ""
            if sep == "" and len(d) == 16:
                sep = "."
            parts.append((sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d, kind))
        elif kind == "ip":
            sep = r.choice(["[.]", "(.)", " . ", ". ", " ."])
            parts.append((sep.join(str(r.randint(0, 255)) for _ in range(4)), kind))
        elif kind == "email":
            at, dot = r.choice([("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" at ", " dot "), (" @ ", "."), (" @ ", " . "), ("{at}", "{dot}"), (" AT ", " DOT ")])
            local = _word(r) + r.choice(["", "." + _word(r), n(2), "_" + _word(r)])
            parts.append((f"{local}{at}{_word(r)}{dot}{r.choice(['com', 'org', 'net', 'de', 'io', 'info'])}", kind))
        else:
            y, m, d = r.randint(1900, 2040), r.randint(10, 12), r.randint(10, 28)
            other = lambda: next(x for x in iter(lambda: _number(r, r.choice([13, 15, 16])), "") if not luhn(x))
            o = other()
            if r.random() < 0.4:
                # A number of another kind after a word that says so, or prose with "at" and "dot".
                isbn = f"{n(1)}-{n(r.choice([2, 3]))}-{n(r.choice([5, 6]))}-{n(1)}"
                decoy = r.choice([
                    f"ISBN {isbn}", f"ISBN 978-{isbn}", f"ISBN-13: 978-{n(1)}-{n(3)}-{n(5)}-{n(1)}", f"ISBN-10 {isbn}", f"ISSN {n(4)}-{n(4)}", f"{r.choice(['invoice', 'order', 'ref', 'ticket', 'PO', 'serial'])} {r.choice(['', '#', 'no ', 'INV-'])}{n(r.choice([7, 8, 10, 13]))}",
                    f"invoice {y}-{n(3)}-{n(4)}", f"order {n(3)}-{n(7)}-{n(7)}", f"part no {n(3)}-{n(3)}-{n(4)}", f"serial {n(4)}-{n(4)}-{n(4)}-{n(4)}",
                    f"{_word(r)} {r.choice(sorted(_PROSE))} at {_word(r)} dot {r.choice(['com', 'org', _word(r)])}", f"{r.choice(['mail', 'write', 'reach', 'call'])} {r.choice(sorted(_PROSE))} at {_word(r)} dot com",
                ])
                parts.append((decoy, None))
                continue
            parts.append((r.choice([
                f"{y}-{m}-{d}", f"{d}/{m}/{y}", f"{d}.{m}.{y}", f"{y}-{m}-{d} 12:30:45", f"{m}:{d}:59", n(7), n(8), n(9), n(10), n(11), n(12), n(6), f"{y}-{y + 5}", f"{n(1)},{n(3)},{n(3)}", f"${n(3)}.{n(2)}",
                f"{n(1)}.{n(1)}.{n(1)}", f"{n(3)} {n(3)}", f"{n(2)} {n(2)} {n(2)} {n(2)}", o, ".".join(o[i : i + 4] for i in range(0, len(o), 4)), " ".join(o[i : i + 4] for i in range(0, len(o), 4)),
                f"978-3-{n(2)}-{n(6)}-{n(1)}", f"no. {n(8)}", f"order {n(9)}", f"{n(4)}/{n(4)}", f"{n(3)}.{n(6)}", f"{n(5)}-{n(4)}", f"{n(3)}[.]{n(4)}[.]1[.]2", f"looking at {_word(r)} dot {_word(r)} and", f"at {_word(r)} . {_word(r)}", f"{_word(r)} @ {n(2)}", f"{_word(r)} @ {_word(r)}", f"({n(3)}) {n(3)}", f"{n(4)} {n(4)} {n(4)}",
            ]), None))
    parts += [(_word(r), None) for _ in range(r.randint(0, 4))]
    text, spans = "", []
    for word, kind in parts:
        text += " " if text else ""
        if kind:
            spans.append((kind, len(text), len(text) + len(word)))
        text += word
    return text + r.choice(["", ".", ",", " ###", "\n"]), spans


@lru_cache(maxsize=2)
def train(sentences: int = 900, rounds: int = 12, rate: float = 0.25, decay: float = 1e-4, seed: int = 5) -> tuple[tuple[str, float], ...]:
    """Weights of maximum conditional likelihood on generated sentences."""
    r = random.Random(seed)
    examples = []
    for _ in range(sentences):
        text, spans = sentence(r)
        base = base_spans(text)
        gold = {(k, a, b) for k, a, b in spans}
        barriers = merged(base)
        for a, b in windows(text):
            segments = Segments(text, a, b, barriers)
            truth = [float((k, segments.tokens[i][0], segments.tokens[j - 1][1]) in gold) for i, j, k, _ in segments.found]
            if segments.found:
                examples.append((segments, truth))
    weights: dict[str, float] = {}

    def move(feature: str, by: float) -> None:
        w = weights.get(feature, 0.0)
        weights[feature] = w + step * (by - decay * w)

    for n in range(rounds):
        r.shuffle(examples)
        step = rate / (1 + 0.3 * n)
        for segments, truth in examples:
            chance, expected = segments.marginals(segments.scores(weights), transitions(weights))
            for (_, _, _, features), p, t in zip(segments.found, chance, truth, strict=True):
                if abs(t - p) > 1e-3:
                    for f in features:
                        move(f, t - p)
            state = STATES[0]
            for (_, _, kind, _), t in sorted(zip(segments.found, truth, strict=True), key=lambda x: x[0][0]):
                if t:
                    expected[STATES.index(state)][STATES.index(kind)] -= 1
                    state = kind
            for a, row in zip(STATES, expected, strict=True):
                for b, extra in zip(STATES, row, strict=True):
                    if abs(extra) > 1e-3:
                        move(f"move {a}>{b}", -extra)
    return tuple(sorted(weights.items()))


# -- operator ---------------------------------------------------------------------------------------------------------


def all_spans(text: str, weights: dict[str, float], margin: float = MARGIN, moves: list[list[float]] | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each by start, then kind."""
    base = base_spans(text)
    barriers = merged(base)
    firsts, lasts = [a for a, _ in barriers], [b for _, b in barriers]
    more: list[Span] = []
    moves = moves or transitions(weights)
    for a, b in windows(text):
        segments = Segments(text, a, b, barriers[bisect_right(lasts, a) : bisect_left(firsts, b)])
        if segments.found:
            for at in segments.best(segments.scores(weights, margin), moves):
                i, j, kind, _ = segments.found[at]
                more.append((kind, segments.tokens[i][0], segments.tokens[j - 1][1]))
    return base, sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and all spans (arrays of kind, start, end; code points, end exclusive) of every text.

    Null and empty texts have no spans; null ids stay null; repeated rows are
    searched one by one; an empty table gives no rows; other columns are
    ignored. No shuffle.
    """
    weights = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = dict(weights)
        moves = transitions(of)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in slices(batches):
            both = [all_spans(t, of, moves=moves) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([named(b) for b, _ in both], kind), pa.array([named(s) for _, s in both], kind)], names=["doc_id", "base", "spans"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_arrow(chosen, run, f"doc_id long, base {spans}, spans {spans}")


def mask(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The columns of ``docs`` with personal data in ``text_col`` masked; ``length_col``, if there, counts the new text. Null texts stay null."""
    weights = train()
    field = next(f for f in docs.schema.fields if f.name == text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = dict(weights)
        moves = transitions(of)
        for batch in slices(batches):
            texts = [t if t is None else mask(t, all_spans(t, of, moves=moves)[1]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "masked"])

    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(packed(others).alias("row"), ref(text_col).alias("text"))
    masked = map_arrow(rows, run, StructType([rows.schema["row"], StructField("masked", StringType())]))
    changed = {text_col: F.col("masked").cast(field.dataType)}
    if length_col in docs.columns:
        changed[length_col] = F.length("masked").cast(docs.schema[length_col].dataType)
    return masked.select([changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
