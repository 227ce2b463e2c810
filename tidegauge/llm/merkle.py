"""Merkle manifest of a table and proofs of its rows (operator 11): Pregel-style supersteps on RDDs.

Every row is a leaf. A source's leaves, in order, are hashed in runs of
``FAN`` until one digest is left, the source's subroot; the subroots are leaves
of one more such tree, whose last digest is the root.

A vertex of the supersteps is ``SPAN`` nodes side by side with the ``LEVELS``
levels above them, so messages between its own nodes never leave a task and a
tree of n leaves takes log(n) / log(SPAN) supersteps each way. Upwards a vertex
that has heard from all its children hashes them and sends its digest to its
parent vertex. Downwards a vertex receives the path above it (what stands left
and right of its digest at each level up to the root), and sends each child
vertex that path with its own siblings in front; at the lowest vertices the
path of each leaf gives the proof, and folding it with the leaf gives a root to
compare. A message goes to a vertex, not to a leaf, so paths are shuffled for
one in ``SPAN`` leaves.

Leaves are numbered without a window over a source: rows are sorted in ranges
of (source, id, digest), and a range's first number in a source is the count
of the ranges before it. A source with a third of all rows is many ranges, and
equal rows are told apart by the place they were read at. Each superstep's
vertices are a written file in the shared folder: what a lost executor held is
read again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import materialise, shared_dir, ship, table

FAN = 3
LEVELS = 6
SPAN = FAN**LEVELS
#: Rows for a task of a superstep: as few as FEW while that keeps within the session's shuffle partitions, at most MANY.
FEW, MANY = 5_000, 500_000

#: What stands left and right of a digest in its run, level by level.
Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(column: Column) -> Column:
    """A value's UTF-8 bytes counted, a colon, and the value; ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def tampered_text() -> Column:
    """The text that is presented for verification: without line feeds for ids whose checksum is even, else the text."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def leaves(docs: DataFrame, presented: Column | None = None) -> DataFrame:
    """(src, doc_id, leaf, shown): ``src`` sorts sources, null first; ``shown`` is the digest of the row with the ``presented`` text where that is another digest."""
    of = lambda text: F.unhex(leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))
    changed = F.lit(None).cast("binary") if presented is None else F.when(~presented.eqNullSafe(F.col("text")), of(presented))
    src = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    return docs.select(src.alias("src"), F.col("doc_id").cast("long").alias("doc_id"), of(F.col("text")).alias("leaf"), changed.alias("shown"))


def placed(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, int, int]:
    """``rows`` with ``place`` (from 0 in the order of its key) and ``total`` (rows of the key); the most rows of a key; all rows."""
    by = [key, *order]
    sorted_rows = rows.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(*by, "read_at").sortWithinPartitions(*by, "read_at").drop("read_at")
    ranged = materialise(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "merkle-ranged").withColumn("part", F.shiftright("at", 33))
    runs = ranged.groupBy(key, "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialise(runs.select(key, "part", (before - F.col("low")).alias("shift"), F.sum("n").over(w).alias("total"), "n"), "merkle-runs")
    size = runs.agg(F.max("total").alias("most"), F.sum("n").alias("rows")).first()
    known = ranged.join(runs.drop("n"), [key, "part"]).withColumn("place", F.col("at") + F.col("shift"))
    return known.drop("part", "at", "shift"), size.most or 0, size.rows or 0


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(-(-rows // MANY), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // FEW)), 1)


def _task_of(vertex: tuple[str, int]) -> int:
    return zlib.crc32(f"{vertex[0]}\0{vertex[1]}".encode())


def levels_above(digests: list[str], alone: bool) -> list[list[str]]:
    """The nodes above side by side digests, level by level: up to one node if these are all of their tree, else ``LEVELS`` levels."""
    found = [digests]
    while len(found[-1]) > 1 if alone else len(found) <= LEVELS:
        low = found[-1]
        found.append([digest("".join(low[at : at + FAN])) for at in range(0, len(low), FAN)])
    return found


def paths_below(levels: list[list[str]], above: Path) -> list[Path]:
    """The path of each of the lowest nodes, given that of the highest."""
    paths = [above]
    for low in reversed(levels[:-1]):
        beside = [("".join(low[at - at % FAN : at]), "".join(low[at + 1 : at - at % FAN + FAN])) for at in range(len(low))]
        paths = [[beside[at], *paths[at // FAN]] for at in range(len(low))]
    return paths


def proof(path: Path) -> str:
    return digest("".join(left + right for left, right in path))


def folded(leaf: str, path: Path) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


class Tree:
    """Supersteps over trees of many keys. ``nodes``: ((key, vertex), (place in it, total of the key, digest as hex, what is carried))."""

    def __init__(self, nodes: RDD, spark: SparkSession, most: int, rows: int):
        self.context, self.folder, self.steps = spark.sparkContext, f"{shared_dir(spark)}/merkle-{uuid4().hex}", []
        self.tasks, done = _tasks(spark, rows), []
        while True:
            vertices = nodes.groupByKey(self.tasks, _task_of).mapValues(_assembled)
            vertices.saveAsPickleFile(f"{self.folder}/{len(self.steps)}")
            vertices = self.context.pickleFile(f"{self.folder}/{len(self.steps)}")
            self.steps.append(vertices)
            done.append(vertices.filter(lambda v: v[1][0] <= SPAN).map(lambda v: (v[0][0], levels_above(v[1][1], True)[-1][0])))
            if most <= SPAN:
                break
            nodes, most = vertices.filter(lambda v: v[1][0] > SPAN).map(_upward), -(-most // SPAN)
        #: (key, its last digest)
        self.tops = self.context.union(done)

    def downward(self, above: RDD) -> RDD:
        """The lowest vertices as (vertex state, word, path above), from (key, (word, path)) of every key; the word goes to all vertices of its key."""
        heard = above.map(lambda m: ((m[0], 0), m[1]))
        inbox = self.context.parallelize([], 1)
        for step in range(len(self.steps) - 1, -1, -1):
            at_top = self.steps[step].filter(lambda v: v[1][0] <= SPAN)
            below = self.steps[step].filter(lambda v: v[1][0] > SPAN)
            met = self.context.union([at_top.join(heard, self.tasks), below.join(inbox, self.tasks)])
            inbox = met.flatMap(_down) if step else met
        return inbox.map(lambda m: m[1])


def _assembled(heard) -> tuple[int, list[str], list]:
    """A vertex that has heard from all its children."""
    children = sorted(heard, key=lambda c: c[0])
    return children[0][1], [c[2] for c in children], [c[3] for c in children]


def _upward(vertex) -> tuple[tuple[str, int], tuple]:
    (key, at), (total, digests, _) = vertex
    return (key, at // SPAN), (at % SPAN, -(-total // SPAN), levels_above(digests, False)[-1][0], None)


def _down(met) -> Iterator[tuple[tuple[str, int], tuple]]:
    (key, at), ((total, digests, _), (word, above)) = met
    for n, path in enumerate(paths_below(levels_above(digests, total <= SPAN), above)):
        yield (key, at * SPAN + n), (word, path)


def _node(row) -> tuple[tuple[str, int], tuple]:
    key, place, total, leaf, cargo = row
    return (key, place // SPAN), (place % SPAN, total, bytes(leaf).hex(), cargo)


def _proved(met, root: str) -> Iterator[tuple]:
    (total, digests, cargo), (subroot, above) = met
    for leaf, (doc_id, shown), path in zip(digests, cargo, paths_below(levels_above(digests, total <= SPAN), above), strict=True):
        again = folded(bytes(shown).hex() if shown is not None else leaf, path)
        yield doc_id, leaf, subroot, root, proof(path), again, again == root


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, presented: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    A leaf is the digest of doc_id, source, lang, n_chars and text. ``presented``
    is the text to verify, the row's own unless given. Within a source, rows
    ascend by id, null first, and rows of one id by digest; equal rows have
    proofs of their own places. Nulls in any column are leaves like others, a
    table of one row has its leaf as root, an empty table gives an empty result,
    other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    # Written first: the sort samples its input and then reads it again, and texts should be read once.
    rows, most, count = placed(materialise(leaves(docs, presented), "merkle-leaves"), "src", ["doc_id", "leaf"])
    if not count:
        return spark.createDataFrame([], SCHEMA)
    cargo = F.struct("doc_id", "shown").alias("cargo")
    tree = Tree(rows.select("src", "place", "total", "leaf", cargo).rdd.map(tuple).map(_node), spark, most, count)
    subroots = spark.createDataFrame(tree.tops, "src string, subroot string").select(F.lit("").alias("one"), "src", F.unhex("subroot").alias("leaf"))
    named, sources, _ = placed(subroots, "one", ["src"])
    over = Tree(named.select("one", "place", "total", "leaf", "src").rdd.map(tuple).map(_node), spark, sources, sources)
    root = over.tops.first()[1]
    above = over.downward(spark.sparkContext.parallelize([("", (None, []))], 1)).flatMap(_to_source)
    return spark.createDataFrame(tree.downward(above).flatMap(lambda met: _proved(met, root)), SCHEMA, verifySchema=False)


def _to_source(met) -> Iterator[tuple[str, tuple[str, Path]]]:
    (total, digests, cargo), (_, above) = met
    for subroot, src, path in zip(digests, cargo, paths_below(levels_above(digests, total <= SPAN), above), strict=True):
        yield src, (subroot, path)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), tampered_text())


#: The rule read level by level: a recursive query for the checksums of ids, one for each tree, one down each.
SQL = r"""
WITH RECURSIVE bits(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
lookup AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
sums(doc_id, rest, state) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, substr(rest, 2), xor(state >> 8, t[1 + (xor(state, ascii(rest)) & 255)]) FROM sums, lookup WHERE rest <> ''),
even AS (SELECT doc_id FROM sums WHERE rest = '' AND xor(state, 4294967295) % 2 = 0),
d AS (SELECT row_number() OVER () AS r, doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    text, CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
l AS (SELECT r, doc_id, coalesce('1' || source, '0') AS src,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS shown FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY src) AS total FROM l),
tree(src, lvl, place, total, h) AS (
  SELECT src, 0, place, total, leaf FROM p
  UNION ALL SELECT src, lvl + 1, place // 3, (total + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM tree WHERE total > 1 GROUP BY src, lvl, total, place // 3),
subs AS (SELECT src, h, row_number() OVER (ORDER BY src) - 1 AS place, count(*) OVER () AS total FROM tree WHERE total = 1),
top(lvl, place, total, h) AS (
  SELECT 0, place, total, h FROM subs
  UNION ALL SELECT lvl + 1, place // 3, (total + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM top WHERE total > 1 GROUP BY lvl, total, place // 3),
beside AS (SELECT a.src, a.lvl, a.place, a.total, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS lft,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS rgt
  FROM tree a JOIN tree b ON a.src = b.src AND a.lvl = b.lvl AND a.place // 3 = b.place // 3 WHERE a.total > 1 GROUP BY ALL),
over_beside AS (SELECT a.lvl, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS lft,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS rgt
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.place // 3 = b.place // 3 WHERE a.total > 1 GROUP BY ALL),
walk(r, src, lvl, place, total, proof, h) AS (
  SELECT r, src, 0, place, total, '', shown FROM p
  UNION ALL SELECT r, src, lvl + 1, place // 3, (total + 2) // 3, proof || lft || rgt, sha256(lft || h || rgt) FROM walk JOIN beside USING (src, lvl, place, total) WHERE total > 1),
over_walk(r, lvl, place, total, proof, h) AS (
  SELECT r, 0, subs.place, subs.total, proof, walk.h FROM walk JOIN subs USING (src) WHERE walk.total = 1
  UNION ALL SELECT r, lvl + 1, place // 3, (total + 2) // 3, proof || lft || rgt, sha256(lft || h || rgt) FROM over_walk JOIN over_beside USING (lvl, place) WHERE total > 1)
SELECT doc_id, leaf, subs.h AS subroot, top.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = top.h AS verified
FROM p JOIN subs USING (src) JOIN over_walk w USING (r) CROSS JOIN top WHERE w.total = 1 AND top.total = 1
"""
