"""SimHash near-duplicates by BK-trees over banded shards (operator 6).

A document's fingerprint has a bit set when over half of its shingles' hashes
have it. Fingerprints within ``radius`` differing bits are linked, and linked
documents form components.

Shards. A search tree over all fingerprints would have to be broadcast and
would grow with the corpus, so fingerprints are dealt into shards that no link
can leave: by the pigeonhole principle two fingerprints within ``radius`` bits
agree on at least one of ``radius + 1`` bands, so a shard is a (band, value).
Each task builds the BK-tree of a shard, children keyed by integer Hamming
distance to their parent, and searches it with every member, following only
edges within the radius; every comparison of two fingerprints is a step of such
a search. Exact copies meet once, as one fingerprint. A shard of more than
``HOT_SHARD`` fingerprints (a large group of near copies) is dealt again by
bands of its other bits, by the same principle; what is still larger than
``BLOCK`` then is cut into blocks, and every pair of blocks is a shard of its
own. Neither loses a pair, and both bound a task's tree.

Links leave a task as a spanning forest: a link whose ends the shard has
already connected adds nothing to components. Components come from alternating
large-star and small-star steps over the links, checkpointed in the shared
folder; links and components stay distributed throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import checkpointed, map_arrow, materialise, slices, table, text_or_empty

SEED = 42
RADIUS = 3
BITS = 64
#: Members above which a shard is dealt again by its other bits.
HOT_SHARD = 512
#: Members of a shard dealt again above which it is searched in pairs of blocks.
BLOCK = 1_024


def byte_bits() -> np.ndarray:
    """Row b: the eight bits of byte b, least significant first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A further 64-bit hash of 64-bit hashes (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Fingerprints:
    """Fingerprints of ``words`` 64-bit words; the first word is the SimHash of the shingles' XXH64 itself."""

    def __init__(self, shingle: int, words: int = 1, seed: int = SEED):
        self.shingle, self.words, self.seed = shingle, words, seed
        self.bits = byte_bits()
        self.places = (np.arange(8 * words) * 256)[None, :]

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        k, digest, seed = self.shingle, xxhash.xxh64_intdigest, self.seed
        if len(words) <= k:
            return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
        if k == 1:
            return np.array([digest(w, seed) for w in words], np.uint64)
        return np.array([digest(s, seed) for s in map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False))], np.uint64)

    def __call__(self, text: str) -> tuple[int, ...]:
        return self.of_hashes(self.hashes(text))

    def of_hashes(self, h: np.ndarray) -> tuple[int, ...]:
        if not len(h):
            return (0,) * self.words
        streams = h[:, None] if self.words == 1 else np.stack([h, *(mix(h, n) for n in range(1, self.words))], axis=1)
        octets = streams.astype("<u8").view(np.uint8).reshape(len(h), 8 * self.words)
        if len(h) < 200:
            sums = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            seen = np.bincount((octets + self.places).ravel(), minlength=2048 * self.words)
            sums = (seen.reshape(8 * self.words, 256) @ self.bits).ravel()
        packed = np.packbits(2 * sums > len(h), bitorder="little").view("<u8")
        return tuple(int(x) for x in packed)


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, f1, ...): one signed long for each 64 bits."""
    names = ["doc_id", *(f"f{n}" for n in range(words))]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprints(shingle, words)
        for batch in slices(batches):
            prints = np.array([of(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(prints[:, n]) for n in range(words))], schema=schema)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_arrow(chosen, run, ", ".join(f"{n} long" for n in names))


class BkTree:
    """Fingerprints (rows of 64-bit words); a node's children are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add_and_search(self, value: int, radius: int) -> list[int]:
        """Nodes within ``radius`` of ``value``, which then becomes a node."""
        found: list[int] = []
        if self.values:
            values, children = self.values, self.children
            todo = [0]
            while todo:
                node = todo.pop()
                d = (values[node] ^ value).bit_count()
                if d <= radius:
                    found.append(node)
                kids = children[node]
                if kids:
                    if len(kids) <= 2 * radius + 1:
                        todo.extend([k for e, k in kids.items() if d - radius <= e <= d + radius])
                    else:
                        todo.extend([kids[e] for e in range(d - radius, d + radius + 1) if e in kids])
            at = 0
            while True:
                d = (values[at] ^ value).bit_count()
                child = children[at].get(d)
                if child is None:
                    children[at][d] = len(values)
                    break
                at = child
        self.values.append(value)
        self.children.append({})
        return found


class Forest:
    """Union-find over a shard's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within ``radius`` among distinct ``values``, as pairs of places."""
    forest, tree = Forest(len(values)), BkTree()
    for i, v in enumerate(values):
        for j in tree.add_and_search(v, radius):
            if forest.join(i, j):
                yield j, i


def _band(words: list[str], at: int, bits: int) -> Column:
    """``bits`` (under 64, within one word) bits of the fingerprint from ``at`` on."""
    return F.shiftrightunsigned(F.col(words[at // 64]), at % 64).bitwiseAND(F.lit((1 << bits) - 1))


def _search(sharded: DataFrame, words: list[str], radius: int) -> DataFrame:
    """Links among rows that share (s1, s2); both ends named by their fingerprint id."""
    n = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by shard; a shard may span batches, so its rows are carried over.
        held: list[np.ndarray] = []

        def links(block: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (block[1:, :2] != block[:-1, :2]).any(axis=1)])
            ends = np.r_[starts[1:], len(block)]
            many = ends - starts > 1
            a, b = [], []
            for i, j in zip(starts[many], ends[many], strict=True):
                ids = block[i:j, 2].tolist()
                cols = block[i:j, 3:].view(np.uint64)
                values = cols[:, 0].tolist()
                for k in range(1, n):
                    values = [v << 64 | w for v, w in zip(values, cols[:, k].tolist(), strict=True)]
                for x, y in shard_links(values, radius):
                    a.append(ids[x])
                    b.append(ids[y])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

        for batch in batches:
            block = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if held:
                block = np.concatenate([*held, block])
            last = np.flatnonzero((block[:, :2] != block[-1, :2]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield links(block[:cut])
            held = [block[cut:]]
        if held and len(held[0]):
            yield links(held[0])

    rows = sharded.select("s1", "s2", "fid", *words)
    rows = rows.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "fid")
    return map_arrow(rows, run, "u long, v long")


def _keys(columns: list[Column]) -> list[Column]:
    """Values of several bands, told apart by the band's number."""
    return [F.lit(n).cast("long") * (1 << 32) + c for n, c in enumerate(columns)]


def block_pairs(member: Column, n: Column, block: int) -> Column:
    """The pairs of blocks, of about ``block`` of the shard's ``n`` members, that ``member`` takes part in; one value for a shard of one block."""
    blocks = F.greatest(F.ceil(n / F.lit(block)).cast("long"), F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64(member, F.lit(1)), blocks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: j != own)
    return F.when(blocks > 1, F.transform(others, lambda j: F.least(own, j) * (1 << 32) + F.greatest(own, j))).otherwise(F.array(F.lit(-1).cast("long")))


def link_fingerprints(prints: DataFrame, words: list[str], bands: list[Column], radius: int, again: Callable[[Column], Column], hot_shard: int = HOT_SHARD, block: int = BLOCK) -> DataFrame:
    """Links (u, v) within ``radius`` bits among distinct fingerprints (fid and ``words``) that share a band's value.

    Shards above ``hot_shard`` are dealt again by ``again(band)``: an array of
    values of which two members of the band's shard share at least one. Those
    are searched in pairs of blocks where they hold over ``block`` members.
    """
    keyed = prints.select("fid", *words, F.inline(F.array(*[F.struct(k.alias("s1"), F.lit(n).alias("band")) for n, k in enumerate(_keys(bands))])))
    none = F.lit(-1).cast("long")
    hot = checkpointed(keyed.groupBy("s1").agg(F.count("*").alias("n")).filter(F.col("n") > hot_shard).select("s1"))
    if not hot.take(1):
        return _search(keyed.select("s1", none.alias("s2"), "fid", *words), words, radius)
    usual = keyed.join(hot, "s1", "left_anti").select("s1", none.alias("s2"), "fid", *words)
    dealt = materialise(keyed.join(hot, "s1").select(F.explode(again(F.col("band"))).alias("s2"), "s1", "fid", *words), "dealt")
    # A shard dealt again is named by one number, so that its pairs of blocks have the other.
    dealt = dealt.select(F.xxhash64("s1", "s2").alias("s1"), "fid", *words)
    sizes = dealt.groupBy("s1").agg(F.count("*").alias("n")).filter("n > 1")
    parts = dealt.join(sizes.hint("merge"), "s1").select("s1", F.explode(block_pairs(F.col("fid"), F.col("n"), block)).alias("s2"), "fid", *words)
    return _search(usual, words, radius).unionByName(_search(parts, words, radius))


def disjoint_bands(radius: int) -> tuple[list[Column], Callable[[Column], Column]]:
    """Bands of a 64-bit fingerprint that two within ``radius`` share one of, and, of the bits outside a band, again such bands."""
    parts = radius + 1
    edges = [BITS * n // parts for n in range(parts + 1)]
    bands = [_band(["f0"], a, b - a) for a, b in zip(edges, edges[1:], strict=False)]

    def outside(n: int) -> Column:
        # The bits outside band n, put side by side, cut into bands.
        low, width = edges[n], edges[n + 1] - edges[n]
        f = F.col("f0")
        below = f.bitwiseAND(F.lit((1 << low) - 1)) if low else F.lit(0).cast("long")
        above = F.shiftleft(F.shiftrightunsigned(f, low + width), low) if low + width < BITS else F.lit(0).cast("long")
        rest, left = below.bitwiseOR(above), BITS - width
        cuts = [left * k // parts for k in range(parts + 1)]
        return F.array(*_keys([F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]))

    def again(band: Column) -> Column:
        found = outside(0)
        for n in range(1, parts):
            found = F.when(band == n, outside(n)).otherwise(found)
        return found

    return bands, again


def components(links: DataFrame) -> DataFrame:
    """(fid, root): each linked id and the least id that it reaches, by alternating large-star and small-star steps."""
    edges = checkpointed(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # Large star: every larger neighbour of u moves to the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = checkpointed(small)
        tell = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tell(after) == tell(edges):
            return after.select(F.col("u").alias("fid"), F.col("v").alias("root"))
        edges = after


def cluster(prints: DataFrame, words: list[str], link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``component_id`` (the least doc_id of the component) to rows of doc_id and ``words``.

    ``link`` gives the links between distinct fingerprints. Null ids take no
    part in the minimum; a component of null ids alone has a null id.
    """
    distinct = prints.groupBy(*words).agg(F.min("doc_id").alias("low"))
    ident = F.col(words[0]) if len(words) == 1 else F.xxhash64(*words)
    distinct = materialise(distinct.withColumn("fid", ident), "fingerprints")
    roots = components(link(distinct))
    low = roots.join(distinct.select("fid", "low"), "fid").select("root", "low").union(
        roots.select("root").distinct().join(distinct.select(F.col("fid").alias("root"), "low"), "root"))
    named = low.groupBy("root").agg(F.min("low").alias("component_id"))
    member = roots.join(named, "root").select("fid", "component_id").union(named.select(F.col("root").alias("fid"), "component_id"))
    known = distinct.join(member, "fid", "left").select(*words, F.coalesce("component_id", "low").alias("component_id"))
    return prints.join(known, words)


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Shingles are of ``shingle`` words (fewer words: all of them; none: the
    fingerprint is zero and links like any other). Null texts count as empty.
    Repeated rows give repeated rows, null ids stay null, an empty table gives
    an empty result, other columns are ignored.
    """
    bands, again = disjoint_bands(radius)
    prints = materialise(fingerprints(docs, shingle, 1, id_col, text_col), "simhash")
    found = cluster(prints, ["f0"], lambda distinct: link_fingerprints(distinct, ["f0"], bands, radius, again))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)
