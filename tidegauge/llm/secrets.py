"""Secret scan with a random forest against false positives, in DataFrame functions only (operator 7).

Candidates are unbroken runs of at least ``MIN_LENGTH`` key characters with a
digit among them. A random forest over the candidate's length, its character
transitions, how much of it dictionary words cover, its path-like surroundings
and the words next to it decides which candidates are secrets. The forest is
trained on labelled findings, by default a seeded set generated here; their
features are computed by the same expressions as those of the texts, the trees
are grown on the driver from that bounded table, and the forest becomes a
column expression, so scanning is a projection over the documents.
"""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import table, text_or_empty

MIN_LENGTH = 16
KEY = r"[A-Za-z0-9+/_=\-]"
#: Starts only where a run starts and gives nothing back, so long runs take linear time.
CANDIDATE = rf"(?<!{KEY})(?=[A-Za-z+/_=\-]*+[0-9]){KEY}{{{MIN_LENGTH},}}+"
BEFORE, AFTER = 48, 24
TREES, DEPTH, LEAF = 15, 5, 4
#: At most so many labelled findings are used.
LABELLED_ROWS = 4_000
SEED = 23

#: Words of identifiers, file names and prose that secrets seldom spell out.
DICTIONARY = (
    "about", "account", "action", "agent", "api", "app", "array", "article", "author", "backup", "base", "blog", "body", "build", "button", "cache", "chapter", "check",
    "class", "client", "code", "column", "commit", "config", "connection", "content", "count", "create", "daily", "data", "date", "default", "delete", "demo", "device",
    "doc", "download", "error", "event", "example", "export", "factory", "feature", "figure", "file", "filter", "final", "from", "function", "get", "group", "guide", "handler",
    "header", "heading", "home", "html", "image", "import", "index", "info", "input", "item", "job", "lib", "line", "list", "local", "log", "main", "manager", "map", "message", "model",
    "module", "month", "name", "network", "node", "note", "number", "object", "option", "order", "output", "overview", "package", "page", "part", "path", "post", "price", "process",
    "product", "profile", "project", "python", "query", "read", "record", "release", "report", "request", "response", "result", "review", "road", "route", "run", "sample", "schema",
    "search", "section", "server", "service", "session", "set", "shop", "site", "size", "source", "spec", "start", "stat", "state", "status", "step", "store", "story", "string",
    "system", "table", "task", "temp", "test", "text", "that", "the", "time", "title", "tool", "tracker", "train", "type", "update", "upload", "user", "util", "value", "version", "view",
    "week", "window", "with", "work", "year",
)
#: Words before a secret, and words before other long runs.
CUES = "secret|token|passw|pwd|api.?key|access.?key|auth|bearer|credential|private.?key|client.?key|signing"
COUNTER_CUES = "commit|sha|md5|checksum|digest|uuid|guid|hash|etag|revision|version|build|isbn|order|invoice|card|phone|base64|image|page|figure|doi|see|file|trace|request.?id|serial"
PREFIXES = "^(AKIA|ASIA|ghp_|gho_|ghs_|xox[abp]-|sk_live_|sk_test_|sk-|AIza|eyJ|glpat-|npm_|SG)"

FEATURES = (
    "length", "digits", "uppers", "symbols", "changes", "hex", "distinct", "dictionary", "vowels", "slashes", "cue", "counter_cue", "assigned", "quoted", "uuid", "prefix",
    "repeated", "in_path", "file_end", "numeric",
)

_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_KIND = "u" * 26 + "l" * 26 + "d" * 10 + "s" * 5


def features(before: Column, candidate: Column, after: Column) -> list[Column]:
    """The FEATURES of a finding, as doubles."""
    length = F.length(candidate).cast("double")
    kinds = F.translate(candidate, _FROM, _KIND)
    share = lambda pattern: F.length(F.regexp_replace(candidate, pattern, "")) / length
    low, near = F.lower(candidate), F.lower(before)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    letters = F.length(F.regexp_replace(candidate, "[^A-Za-z]", ""))
    values = {
        "length": length,
        "digits": share("[^0-9]"),
        "uppers": share("[^A-Z]"),
        "symbols": share("[A-Za-z0-9]"),
        "changes": (F.length(F.regexp_replace(kinds, r"(.)\1++", "$1")) - 1) / length,
        "hex": yes(candidate.rlike("^([0-9a-f]++|[0-9A-F]++)$")),
        "distinct": F.size(F.array_distinct(F.split(F.substring(candidate, 1, 256), ""))) / F.least(length, F.lit(64.0)),
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / length,
        "vowels": F.length(F.regexp_replace(low, "[^aeiou]", "")) / F.greatest(letters, F.lit(1)),
        "slashes": F.length(F.regexp_replace(candidate, "[^/]", "")).cast("double"),
        "cue": yes(near.rlike(CUES)),
        "counter_cue": yes(near.rlike(COUNTER_CUES)),
        "assigned": yes(before.rlike(r"""[=:>]\s?["']?$""")),
        "quoted": yes(before.rlike("""["']$""") & after.rlike("""^["']""")),
        "uuid": yes(candidate.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")),
        "prefix": yes(candidate.rlike(PREFIXES)),
        "repeated": yes(candidate.rlike(r"(.)\1{5}")),
        "in_path": yes(before.rlike(r"(https?:|www\.|[/\\.~])[^\s\"'=]*$")),
        "file_end": yes(after.rlike(r"^[./?#][A-Za-z0-9]")),
        "numeric": yes(candidate.rlike(r"^[0-9\-_/=+]++$")),
    }
    return [values[n].cast("double").alias(n) for n in FEATURES]


# -- labelled findings ------------------------------------------------------------------------------------------------


def generated_findings(n: int = 3_000, seed: int = SEED) -> list[tuple[str, str, str, bool]]:
    """(before, candidate, after, is a secret) of made-up findings; half of them secrets."""
    r = random.Random(seed)
    hexa, full = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: r.choice(DICTIONARY) if r.random() < 0.5 else "".join(r.choice("bcdfglmnprstvwh") + r.choice("aeiou") + r.choice(["", "n", "r", "s"]) for _ in range(r.randint(1, 3)))
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    number = lambda k: some("0123456789", k)
    out: list[tuple[str, str, str, bool]] = []
    while len(out) < n:
        good = len(out) % 2 == 0
        if good:
            c = r.choice([
                lambda: some(hexa, r.choice([32, 40, 40, 48, 64])), lambda: some(full, r.randint(20, 64)), lambda: some(full + "+/", r.choice([24, 40, 43, 44, 64])) + r.choice(["", "=", "=="]),
                lambda: "AKIA" + some(full[:26] + "234567", 16), lambda: r.choice(["ghp_", "gho_", "npm_"]) + some(full, 36), lambda: r.choice(["sk_live_", "sk_test_"]) + some(full, 24),
                lambda: "AIza" + some(full + "-_", 35), lambda: "eyJ" + some(full + "-_", r.randint(30, 90)), lambda: "xoxb-" + number(11) + "-" + some(full, 24), lambda: "glpat-" + some(full + "-_", 20),
            ])()
            cue = r.choice(["token", "secret", "api_key", "apikey", "API-KEY", "password", "access_key", "auth_token", "client_secret", "Bearer", "Authorization", "credentials", "private_key", "AWS_SECRET_ACCESS_KEY"])
            joint, quote = r.choice([" = ", "=", ": ", ":", " "]), r.choice(['"', '"', "'", ""])
            before, after = (prose() + r.choice([" ", "\n", "; ", "{"]) + cue + joint + quote, quote + r.choice([" ", "\n", ";", ",", "", " " + word()]))
            if r.random() < 0.12:
                before, after = r.choice([prose() + " ", ""]), r.choice([" " + prose(), "", "."])
        else:
            words = [word() for _ in range(r.randint(3, 6))]
            c, before, after = r.choice([
                lambda: (some(hexa, 40), prose() + " commit ", " " + prose()), lambda: (some(hexa, 64), prose() + r.choice([" sha256:", " sha256 ", " checksum: ", ' digest = "']), " "), lambda: (some(hexa, 32), r.choice(["md5 ", "etag: \"", "hash=", "trace "]), '"'),
                lambda: ("-".join([some(hexa, 8), some(hexa, 4), some(hexa, 4), some(hexa, 4), some(hexa, 12)]), prose() + r.choice([" id ", " uuid: ", " "]), " "), lambda: (number(r.randint(16, 22)), prose() + " ", " " + prose()), lambda: ("-".join(number(4) for _ in range(4)), prose() + " ", ", "),
                lambda: ("-".join(words) + "-" + number(r.randint(1, 4)), r.choice(["https://www.site.com/", prose() + " /", "see "]), r.choice([".html", "/", "?x=1", " "])), lambda: ("/".join(words) + "/v" + number(1), r.choice([" /", " ~/", "in "]), r.choice([".py", ".txt", " "])),
                lambda: ("_".join(words) + number(2), prose() + " ", r.choice([" ", "(", "."])), lambda: ("".join(w.title() for w in words) + number(1), prose() + " ", r.choice(["(", " ", ";"])), lambda: (f"{r.randint(1990, 2040)}-{number(2)}-{number(2)}-" + "-".join(words), "/posts/", ".md"),
                lambda: (f"{r.randint(1990, 2040)}-{number(2)}-{number(2)}_{number(2)}-{number(2)}-{number(2)}", prose() + " ", " "), lambda: (r.choice("=-_") * r.randint(12, 40) + number(4), prose() + "\n", "\n"), lambda: (some("01", 1) * r.randint(16, 40), prose() + " ", " "),
                lambda: ("iVBORw0KGgo" + some(full + "+/", r.randint(60, 90)), "data:image/png;base64,", r.choice(['"', ")"])), lambda: ("".join(words) + number(r.randint(1, 3)) + "".join(words[:2]), prose() + " ", " " + prose()), lambda: (number(8) + "=" + number(8), prose() + " ", " "),
                lambda: (some(hexa, 24), prose() + r.choice([" build ", " revision ", " serial: "]), " "), lambda: ("_".join(words).upper() + "_" + number(1), prose() + " ", r.choice([" = ", "="])), lambda: ("-".join(words) + "-" + number(2), 'token_file = "', '.json"'), lambda: ("_".join(words) + "_" + number(1), "secret: ", " "),
            ])()
        if len(c) >= MIN_LENGTH and any(x.isdigit() for x in c):
            out.append((before[-BEFORE:], c, after[:AFTER], good))
    return out


def labelled(spark: SparkSession, findings: Sequence[tuple[str, str, str, bool]]) -> DataFrame:
    """Findings as a DataFrame (before, candidate, after, secret)."""
    rows = json.dumps([{"before": b, "candidate": c, "after": a, "secret": s} for b, c, a, s in findings])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<before:string,candidate:string,after:string,secret:boolean>>")))


# -- forest -----------------------------------------------------------------------------------------------------------

Tree = tuple | float


def _gini_split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[int, float] | None:
    best, found = len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, None
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, hits = x[order, c], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(y) - n >= LEAF)
        if not ok.any():
            continue
        p, q = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
        cost = np.where(ok, n * 2 * p * (1 - p) + (len(y) - n) * 2 * q * (1 - q), np.inf)
        at = int(np.argmin(cost))
        if cost[at] < best:
            best, found = float(cost[at]), (int(c), float((v[at] + v[at + 1]) / 2))
    return found


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    split = _gini_split(x, y, rng.permutation(x.shape[1])[: max(1, int(x.shape[1] ** 0.5) + 2)])
    if split is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    left = x[:, split[0]] <= split[1]
    return (*split, _grow(x[left], y[left], depth - 1, rng), _grow(x[~left], y[~left], depth - 1, rng))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Tree]:
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(_grow(x[rows], y[rows], depth, rng))
    return forest


def _tree_column(tree: Tree, of: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, limit, left, right = FEATURES[tree[0]], tree[1], tree[2], tree[3]
    return F.when(of[name] <= limit, _tree_column(left, of)).otherwise(_tree_column(right, of))


def forest_column(forest: list[Tree], of: Column) -> Column:
    """Mean of the trees' probabilities for the feature struct ``of``."""
    total = F.lit(0.0)
    for tree in forest:
        total = total + _tree_column(tree, of)
    return total / float(len(forest))


def train(findings: DataFrame, rows: int = LABELLED_ROWS) -> list[Tree]:
    """A forest from at most ``rows`` labelled findings (the least by a hash)."""
    chosen = findings.orderBy(F.xxhash64("before", "candidate", "after"), "candidate").limit(rows)
    got = chosen.select(*features(F.col("before"), F.col("candidate"), F.col("after")), F.col("secret").cast("double").alias("y")).collect()
    data = np.array(got, dtype=float).reshape(len(got), len(FEATURES) + 1)
    return grow_forest(data[:, :-1], data[:, -1])


@lru_cache(maxsize=1)
def _default_findings() -> tuple[tuple[str, str, str, bool], ...]:
    return tuple(generated_findings())


# -- operator ---------------------------------------------------------------------------------------------------------


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (code points, end exclusive), before, candidate, after of every candidate."""
    text = text_or_empty(text_col)
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("between"))
    pieces = pieces.filter(F.size("found") > 0)
    # Where each candidate starts: running sums of what lies before it.
    lengths = F.transform("found", lambda c, i: F.length(c) + F.length(F.get(F.col("between"), i)))
    rows = pieces.select("doc_id", F.posexplode(F.arrays_zip(
        F.col("found").alias("candidate"), F.transform("found", lambda c, i: F.right(F.get(F.col("between"), i), F.lit(BEFORE))).alias("before"),
        F.transform("found", lambda c, i: F.left(F.get(F.col("between"), i + 1), F.lit(AFTER))).alias("after"), _running(lengths).alias("end"))))
    rows = rows.select("doc_id", "col.*")
    return rows.select("doc_id", (F.col("end") - F.length("candidate")).alias("start"), "end", "before", "candidate", "after")


def _running(lengths: Column) -> Column:
    """Running sums, in blocks so that a text with very many candidates takes n * sqrt(n) steps and not n * n."""
    block = 256
    start = F.lit(0).cast("long")
    blocks = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(0), (F.size(a) - 1).cast("int"), F.lit(block))).otherwise(F.array().cast("array<int>"))
    total = lambda a: F.aggregate(a, start, lambda s, x: s + x)
    within = lambda a: F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i + 1)))
    parts = lambda a: F.transform(blocks(a), lambda b: F.slice(a, b + 1, F.lit(block)))
    joined = lambda ps: F.flatten(F.transform(ps, lambda p, i: F.transform(within(p), lambda x: x + total(F.transform(F.slice(ps, F.lit(1), i), total)))))
    let = lambda v, body: F.transform(F.array(v), body)[0]
    return let(lengths, lambda a: let(parts(a), joined))


def scan(docs: DataFrame, forest: list[Tree] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, candidate, probability and is_secret of every candidate of every text.

    Null and empty texts have no candidates, so no rows; null ids stay null;
    repeated rows give repeated rows; an empty table gives an empty result;
    other columns are ignored. No shuffle.
    """
    forest = forest or train(labelled(docs.sparkSession, _default_findings()))
    rows = candidates(docs, id_col, text_col)
    rows = rows.withColumn("f", F.struct(*features(F.col("before"), F.col("candidate"), F.col("after"))))
    scored = rows.select("doc_id", "start", "end", "candidate", forest_column(forest, F.col("f")).alias("probability"))
    return scored.withColumn("is_secret", F.col("probability") >= threshold)


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
