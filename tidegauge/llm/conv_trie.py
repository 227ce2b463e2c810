"""Prefix trie of conversations (operator 13): a Cartesian tree over the sorted conversations' LCP array.

A conversation is the sequence of its turns' digests, and L[i] is the number
of turns that sorted conversation i shares with the one before it. A trie node
is a depth d and a largest range [p, q) of neighbours that share d turns, so
the ranges are those between each L[i]'s nearest smaller values on either side:
the nodes of the Cartesian tree over L, those of equal values in one range
merged. A range stands for all depths from above its two smaller values to its
own value; these are expanded with the range's members.

Nearest smaller values are found in parallel. The conversations are sorted in
ranges, each a block. A sweep over a block with a stack closes every range that
lies in it; what stays open are the block's prefix minima and suffix minima,
which leave as a short sequence of boundaries, each with the sums of all
conversations up to the next. ``FAN`` blocks' sequences are one sequence to
sweep, and so on until one is left. A stair of s minima needs conversations of
up to s turns, so it has at most about the root of twice the turns in its block.

What a node needs adds up along the range: members, the least id, childless
ends, and the words W[i](L[i]) of the shared turns, as
``saved_tokens = sum of W[i](L[i]) inside the range - (members - 1) * W(d - 1)``.
Only a range's top node waits for its parent's id: it gets it when the parent
closes, in the same sweep or, by the number of the parent's boundary, later.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5, sha256
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import map_arrow, materialise, table

#: Bytes of a turn's digest.
WIDTH = 16
#: Conversations in a block at most, on average; blocks whose open boundaries are swept together.
BLOCK_ROWS = 250_000
FAN = 256
#: Conversations whose number has this divisor's remainder 0 lend their first turns to the others.
FAMILY = 20
HEADS = 4
_NO_ENDS = sha256(b"").hexdigest()
#: Rows sent from a worker at once.
OUT_ROWS = 4_096

#: Members, least id, childless ends, words: of some conversations side by side.
Sums = tuple[int, int, int, int]


def plus(*parts: Sums | int | None) -> Sums | None:
    """Sums of neighbours; a number is words of a boundary between them."""
    n, least, leaves, words = 0, None, 0, 0
    for part in parts:
        if isinstance(part, int):
            words += part
        elif part is not None:
            n, least, leaves, words = n + part[0], part[1] if least is None else min(least, part[1]), leaves + part[2], words + part[3]
    return (n, least, leaves, words) if n else None


@dataclass(slots=True)
class Group:
    """Boundaries of one value with none smaller between them, while their range is open."""

    x: int
    level: int
    cum: list[int]
    k: int = 1
    ends: int = 0
    digest: str | None = None
    #: Between the nearest smaller boundary before and the first of these, and between the first and the last of these.
    left: Sums | None = None
    inside: Sums | None = None
    children: list[tuple] = field(default_factory=list)
    members: list[int] = field(default_factory=list)

    @property
    def words(self) -> int:
        return self.cum[self.level] if self.level > 0 else 0


class Sweep:
    """One pass over boundaries in order. ``nodes`` are finished, ``waiting`` are nodes with the number of their parent's boundary, ``items`` what stays open."""

    def __init__(self):
        self.stack: list[Group] = []
        #: Conversations since the newest boundary.
        self.tail: Sums | None = None
        self.nodes, self.waiting, self.items, self.named, self.merged = [], [], [], [], []

    def boundary(self, new: Group, orphans: list[tuple] | None = None) -> None:
        body, orphans, stack = self.tail, orphans or [], self.stack
        while stack and stack[-1].level > new.level:
            group = stack.pop()
            if not stack:
                self.leave(group, body)
                body = None
                continue
            below = stack[-1].level
            body = self.close(group, body, max(below, new.level) + 1, stack[-1].children if below >= new.level else orphans)
        if stack and stack[-1].level == new.level:
            old, words = stack[-1], new.words
            old.inside = plus(*((old.inside, words) if old.k > 1 else ()), body, *((words, new.inside) if new.k > 1 else ()))
            old.k, old.ends, old.digest = old.k + new.k, old.ends + new.ends, old.digest or new.digest
            old.members += new.members
            old.children += orphans
        else:
            new.left, new.children = body, orphans
            stack.append(new)
        self.tail = None

    def close(self, group: Group, right: Sums | None, low: int, parent: list[tuple]) -> Sums:
        whole = plus(group.left, group.words, *((group.inside, group.words) if group.k > 1 else ()), right)
        self.expand(whole, group.cum, low, group.level, group.k + 1 - group.ends, group.digest, parent)
        self.nodes += [(*child[:2], whole[1], *child[2:]) for child in group.children]
        self.named += [(x, whole[1]) for x in group.members]
        return whole

    def expand(self, whole: Sums, cum: list[int], low: int, high: int, children: int, digest: str | None, parent: list[tuple]) -> None:
        """The nodes of a range at depths ``low`` to ``high``; the first waits with its parent's group unless it is the root."""
        n, least, leaves, words = whole
        for d in range(low, high + 1):
            saved = words - (n - 1) * (cum[d - 1] if d > 0 else 0)
            rest = (n, children if d == high else 1, leaves, saved, (digest or _NO_ENDS) if d == high else _NO_ENDS)
            if d > low or d == 0:
                self.nodes.append((least, d, least if d else None, *rest))
            else:
                parent.append((least, d, *rest))

    def leave(self, group: Group, cell: Sums | None) -> None:
        """What a later sweep needs of a group that stays open."""
        self.items.append((group.x, group.level, group.cum[: max(group.level, 0) + 1], group.k, group.ends, group.digest, group.inside, cell))
        self.waiting += [(group.x, *child) for child in group.children]
        self.merged += [(x, group.x) for x in group.members]

    def stop(self) -> None:
        """The end of a block: all groups on the stack stay open."""
        cells = [g.left for g in self.stack[1:]] + [self.tail]
        for group, cell in zip(self.stack, cells, strict=True):
            self.leave(group, cell)
        self.stack, self.tail = [], None

    def finish(self) -> None:
        """The end of all: nothing stays open."""
        self.boundary(Group(-1, -1, []))


def shared(a: bytes, b: bytes) -> int:
    """The number of turns that two sequences of digests begin with alike."""
    n, at = min(len(a), len(b)), 0
    for step in (64 * WIDTH, WIDTH):
        while at + step <= n and a[at : at + step] == b[at : at + step]:
            at += step
    return at // WIDTH


def run_name(key: bytes) -> str:
    """The name of a run of equal conversations that may go on in another block."""
    return "run:" + md5(key).hexdigest()


class Block:
    """The sweep over a block's conversations in order, with the newest one of the block before and the first of the block after."""

    def __init__(self, before: bytes | None):
        self.sweep, self.before, self.runs = Sweep(), before, []
        self.key: bytes | None = None

    def add(self, x: int, conv_id: int, key: bytes, words: list[int]) -> None:
        cum = [0, *accumulate(words)]
        if self.key is None:
            level = -1 if self.before is None else shared(self.before, key)
            new = Group(x, level, cum)
            if self.before is not None and len(self.before) == level * WIDTH:
                new.ends, new.digest = 1, run_name(self.before)
            self.sweep.boundary(new)
            self.ids, self.began = [], self.before == key
        else:
            level = shared(self.key, key)
            new, orphans = Group(x, level, cum), []
            self._settle(level, key == self.key, False, orphans, new)
            if key != self.key:
                self.ids, self.began = [], False
            self.sweep.boundary(new, orphans)
        self.key, self.level, self.cum = key, level, cum
        self.ids.append(conv_id)

    def _settle(self, after: int, goes_on: bool, crosses: bool, orphans: list[tuple], new: Group | None) -> None:
        """What the newest conversation is, once the number of turns shared with the next one is known."""
        sweep, n, conv_id = self.sweep, len(self.key) // WIDTH, self.ids[-1]
        several = self.began or len(self.ids) > 1
        sweep.tail = (1, conv_id, int(after < n), 0)
        if after == n and new is not None:
            new.ends += 1
        if after < n and self.level == n:
            sweep.stack[-1].ends += 1
        if goes_on:
            return
        if self.began or crosses:
            digest = run_name(self.key)
            self.runs += [(digest, i) for i in self.ids]
        else:
            digest = sha256(",".join(map(str, self.ids)).encode()).hexdigest()
        if several:
            sweep.stack[-1].digest = digest
        elif after < n:
            sweep.expand(sweep.tail, self.cum, max(self.level, after) + 1, n, 0, digest, sweep.stack[-1].children if self.level >= after else orphans)
        elif new is not None:
            new.digest = digest

    def end(self, x: int | None, key: bytes | None) -> None:
        after, orphans = -1 if key is None else shared(self.key, key), []
        self._settle(after, False, after * WIDTH == len(self.key), orphans, None)
        self.sweep.waiting += [(x, *child) for child in orphans]
        self.sweep.stop()


_SUMS = "struct<n:bigint,least:bigint,leaves:bigint,words:bigint>"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SWEPT = f"kind string, x long, {_NODE}, block long, at long, level long, cum array<bigint>, k long, ends long, inside {_SUMS}, cell {_SUMS}"
_COLUMNS = [c.split()[0] for c in "kind x conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256 block at level cum k ends inside cell".split()]
_ARROW_SUMS = pa.struct([(c, pa.int64()) for c in ("n", "least", "leaves", "words")])
_ARROW = pa.schema([(c, {"kind": pa.string(), "ends_sha256": pa.string(), "cum": pa.list_(pa.int64()), "inside": _ARROW_SUMS, "cell": _ARROW_SUMS}.get(c, pa.int64())) for c in _COLUMNS])


def _sent(sweep: Sweep, block: int, runs: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """A sweep's results as rows told apart by ``kind``."""
    sums = lambda s: s and dict(zip(("n", "least", "leaves", "words"), s, strict=True))
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

    def rows() -> Iterator[dict]:
        for node in sweep.nodes:
            yield {"kind": "node", **dict(zip(names, node, strict=True))}
        for x, least, depth, *rest in sweep.waiting:
            yield {"kind": "waiting", "x": x, **dict(zip(names, (least, depth, None, *rest), strict=True))}
        for at, (x, level, cum, k, ends, digest, inside, cell) in enumerate(sweep.items):
            yield {"kind": "item", "x": x, "block": block, "at": at, "level": level, "cum": cum, "k": k, "ends": ends, "ends_sha256": digest, "inside": sums(inside), "cell": sums(cell)}
        for x, least in sweep.named:
            yield {"kind": "named", "x": x, "conv_id": least}
        for x, leader in sweep.merged:
            yield {"kind": "merged", "x": x, "at": leader}
        for name, conv_id in runs:
            yield {"kind": "run", "ends_sha256": name, "conv_id": conv_id}

    held = []
    for row in rows():
        held.append(row)
        if len(held) == OUT_ROWS:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _sweep_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, step, x, conv_id, key, words), sorted: of each part the one before (step 0), its own (1), the one after (2)."""
    for part, rows in groupby(_rows(batches), key=lambda r: r[0]):
        block, before, after = None, None, (None, None)
        for _, step, x, conv_id, key, words in rows:
            if step == 0:
                before = key
            elif step == 2:
                after = x, key
            else:
                block = block or Block(before)
                block.add(x, conv_id, key, words)
        block.end(*after)
        yield from _sent(block.sweep, part, block.runs)


def _sweep_items(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows (group, block, at, x, level, cum, k, ends, digest, inside, cell), sorted: what stayed open in the blocks of each group."""
    sums = lambda s: s and (s["n"], s["least"], s["leaves"], s["words"])
    for group, rows in groupby(_rows(batches), key=lambda r: r[0]):
        sweep = Sweep()
        for _, _, _, x, level, cum, k, ends, digest, inside, cell in rows:
            sweep.boundary(Group(x, level, cum, k, ends, digest, None, sums(inside), [], [x]))
            sweep.tail = sums(cell)
        sweep.finish() if last else sweep.stop()
        yield from _sent(sweep, group, [])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words): each conversation's first turns taken from its family's, then its own others; digests side by side and words of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).alias("t"))
    own = materialise(turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns")), "trie-turns")
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    met = own.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("family"), "left").withColumn("h", h)
    both = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return met.select("conv_id", both.alias("turns")).select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["words"].cast("long")).alias("words"))


def blocks_of(sequences: DataFrame, block_rows: int) -> DataFrame:
    """(part, step, x, conv_id, key, words): sorted sequences in blocks, each with the neighbours before and after it."""
    spark = sequences.sparkSession
    n = sequences.count()
    parts = max(1, -(-n // block_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1_000)))
    ordered = sequences.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("x", F.monotonically_increasing_id())
    ordered = materialise(ordered, "trie-sorted").withColumn("part", F.shiftright("x", 33))
    edges = ordered.groupBy("part").agg(F.min("x").alias("low"), F.min_by("key", "x").alias("first"), F.max_by("key", "x").alias("last"))
    # One row a block.
    w = Window.orderBy("part")
    edges = edges.select("part", F.lag("last").over(w).alias("before"), F.lead("low").over(w).alias("next"), F.lead("first").over(w).alias("after"))
    ends = edges.select("part", F.inline(F.array(
        F.struct(F.lit(0).alias("step"), F.lit(None).cast("long").alias("x"), F.col("before").alias("key")), F.struct(F.lit(2).alias("step"), F.col("next").alias("x"), F.col("after").alias("key"))))).filter("key IS NOT NULL")
    own = ordered.select("part", F.lit(1).alias("step"), "x", "conv_id", "key", "words")
    rows = own.unionByName(ends.select("part", "step", "x", F.lit(None).cast("long").alias("conv_id"), "key", F.lit(None).cast("array<bigint>").alias("words")))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "step", "x")


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, digest) of rows (name, conv_id), sorted; a run is read as a stream."""
    for name, rows in groupby(_rows(batches), key=lambda r: r[0]):
        state = sha256()
        for at, (_, conv_id) in enumerate(rows):
            state.update(b",%d" % conv_id if at else b"%d" % conv_id)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], names=["name", "digest"])


def trie_of(sequences: DataFrame, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """The trie's nodes, of rows (conv_id, key, words) with one row an id."""
    swept = [materialise(map_arrow(blocks_of(sequences, block_rows), _sweep_blocks, _SWEPT), "trie-swept")]
    runs = swept[0].filter("kind = 'run'").select("ends_sha256", "conv_id")
    while True:
        items = swept[-1].filter("kind = 'item'")
        span = items.agg(F.min("block").alias("low"), F.max("block").alias("high")).first()
        if span.low is None:
            break
        last = span.high - span.low < fan
        group = F.lit(0).cast("long") if last else F.floor(F.col("block") / fan)
        dealt = items.select(group.alias("group"), "block", "at", "x", "level", "cum", "k", "ends", "ends_sha256", "inside", "cell")
        dealt = dealt.repartition("group").sortWithinPartitions("group", "block", "at")
        swept.append(materialise(map_arrow(dealt, lambda b, last=last: _sweep_items(b, last), _SWEPT), "trie-swept"))
        if last:
            break
    columns = [c.split()[0] for c in _NODE.split(", ")]
    found, known = None, None
    for step in reversed(swept):
        nodes = step.filter("kind = 'node'").select(columns)
        if known is not None:
            # The boundaries that stayed open in this step, with what the next steps found of their ranges.
            waiting = step.filter("kind = 'waiting'").drop("parent_conv_id").join(known, "x")
            nodes = nodes.unionByName(waiting.select(columns))
        found = nodes if found is None else found.unionByName(nodes)
        named = step.filter("kind = 'named'").select("x", F.col("conv_id").alias("parent_conv_id"))
        merged = step.filter("kind = 'merged'").select(F.col("x").alias("own"), F.col("at").alias("x"))
        known = named if known is None else named.unionByName(merged.join(known, "x").select(F.col("own").alias("x"), "parent_conv_id"))
    digests = map_arrow(runs.repartition("ends_sha256").sortWithinPartitions("ends_sha256", "conv_id"), _hash_runs, "name string, digest string")
    # At most two runs a block go on in another one.
    return found.join(F.broadcast(digests), F.col("ends_sha256") == F.col("name"), "left").withColumn("ends_sha256", F.coalesce("digest", "ends_sha256")).select(columns)


def prefix_trie(conversations: DataFrame, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the rebuilt conversations' trie.

    Turns stand by ``turn``, null first, equal ones by digest (repeated rows are
    turns). Rows without an id belong to no conversation. A null role or text is
    empty. A conversation without any turns left is a member of the root. An
    empty table gives an empty result; other columns are ignored. One
    conversation's digests (16 bytes a turn) are one row.
    """
    return trie_of(materialise(rebuilt(conversations), "trie-rebuilt"), block_rows, fan)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Every prefix of every rebuilt conversation, grouped; subtrees by each node's ancestors.
SQL = r"""
WITH RECURSIVE bits(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
lookup AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
sums(conv_id, rest, state) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 4294967295 FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, substr(rest, 2), xor(state >> 8, t[1 + (xor(state, ascii(rest)) & 255)]) FROM sums, lookup WHERE rest <> ''),
heads AS (SELECT conv_id, xor(state, 4294967295) % 4 AS h FROM sums WHERE rest = ''),
turns AS (SELECT conv_id, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'g': digest, 'w': words} ORDER BY turn NULLS FIRST, digest) AS t FROM turns GROUP BY conv_id),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.t, [])[1:h], o.t[h + 1:]) AS t
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
sized AS (SELECT conv_id, list_transform(t, lambda x: x.g) AS g, list_transform(t, lambda x: x.w) AS w, len(t) AS n FROM rebuilt),
prefixes AS (SELECT conv_id, n, d, md5(array_to_string(g[1:d], '')) AS p, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS words FROM sized, unnest(range(0, n + 1)) AS u(d)),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM prefixes GROUP BY d, p),
linked AS (SELECT nodes.*, up.p AS parent, above.conv_id AS parent_conv_id FROM nodes
  LEFT JOIN prefixes up ON up.conv_id = nodes.conv_id AND up.d = nodes.d - 1 LEFT JOIN nodes above ON above.d = up.d AND above.p = up.p),
counted AS (SELECT a.*, (SELECT count(*) FROM linked b WHERE b.parent = a.p AND b.d = a.d + 1) AS n_children FROM linked a),
subtree AS (SELECT up.d, up.p, sum((c.n_children = 0)::BIGINT) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens
  FROM counted c JOIN prefixes up ON up.conv_id = c.conv_id AND up.d <= c.d GROUP BY up.d, up.p)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN subtree USING (d, p)
"""
