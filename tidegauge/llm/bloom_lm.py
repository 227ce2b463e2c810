"""Language-model scoring from a log-frequency Bloom filter (operator 10).

Training counts all words (named by 128-bit hashes, of which no two words share
one but with a chance of 2**-128) and adjacent pairs (64-bit) of the training
texts, in blocks, summed by a shuffle. Long texts are taken in pieces. A count ``n`` is quantised to
level ``q`` with ``1.5**(q-1) <= n < 1.5**q``; the filter holds the items
(hash, 2) to (hash, q), or (hash, 1) of what is seen once, so probing level after
level until one is missing gives back the level, one-sided: never too low, too high
with the filter's false positive rate. The level stands for the least count in it.

Smoothing: P(w | v) = (1 - k) P1(w) + k c(v, w) / C(v). P1 is the quantised
unigram model with half a count added for each known word and one for the
unknown; C(v) is the greatest count of v's level, so that the pair part sums to
at most 1; k = WEIGHT * c(v) / (c(v) + KAPPA), 0 for a context never seen.

Bounds. The filter is broadcast and so has at most ``MAX_FILTER_BITS``; it has
``BITS_PER_ITEM`` bits for an item. Counts are gathered over all training text
whatever its size; words and pairs enter by falling count level until the items
fit, the last level's pairs for as many of the filter's blocks as there is room. All others keep their exact counts: a token of which the filter does not
tell everything leaves the worker with what it does tell, and joins of these
tokens with the counts below the filter's levels give the rest, a share of the
pairs at a time; each share's sums are written before the next is shuffled. (What a training
text holds and the filter does not was seen once where all else is in the filter,
and needs no join.) Exact word counts are needed for the base score: those of at
most ``HEAD_WORDS`` commonest words are broadcast, all others reach the documents
that hold them by a join.

The filter is built in ``BLOCKS`` blocks by hash prefix, each by one task; only
finished blocks come to the driver.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import map_arrow, materialise, slices, table, text_or_empty
from tidegauge.llm.word_hash import WordHasher, distinct, finalise

BASE = 1.5
MAX_FILTER_BITS = 1 << 28
BITS_PER_ITEM = 10
PROBES = 4
BLOCKS = 256
HEAD_WORDS = 1 << 20
#: Characters of text that a worker counts or scores at once.
BLOCK_CHARS = 6_000_000
#: Tokens over which a worker sums its counts before they are shuffled.
HELD_TOKENS = 1 << 22
#: Counts are shuffled as one array for each value of the first so many bits of their hashes.
BUCKET_BITS = 12
_GAP = re.compile(r"[\x20\x09-\x0D]")
WEIGHT = 0.35
KAPPA = 8.0

END, END_SECOND = np.uint64(0x5E4D3C2B1A09F8E7), np.uint64(0x1F83D9ABFB41BD6B)


def level_floor(q: np.ndarray) -> np.ndarray:
    """The least count of level ``q`` (0 of level 0)."""
    return np.where(q > 0, np.ceil(BASE ** (np.asarray(q, np.float64) - 1) - 1e-9), 0.0)


def level_top(q: np.ndarray) -> np.ndarray:
    """The greatest count of level ``q``."""
    return np.maximum(level_floor(np.asarray(q) + 1) - 1, level_floor(q))


#: Both of all levels that a 64-bit count can have.
FLOORS, TOPS = level_floor(np.arange(128)), level_top(np.arange(128))


def level_of(n: np.ndarray) -> np.ndarray:
    """The level of counts of 1 or more."""
    return (np.floor(np.log(n) / np.log(BASE) + 1e-9) + 1).astype(np.int16)


def _level_column(n: str):
    return F.floor(F.ln(F.col(n).cast("double")) / F.lit(float(np.log(BASE))) + F.lit(1e-9)).cast("int") + 1


def _floor_column(q: Column) -> Column:
    """As ``level_floor``."""
    return F.when(q > 0, F.ceil(F.pow(F.lit(BASE), q - 1) - 1e-9)).otherwise(0).cast("double")


def _top_column(q: Column) -> Column:
    """As ``level_top``."""
    return F.greatest(_floor_column(q + 1) - 1, _floor_column(q))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return finalise(first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(32))) + np.uint64(0x632BE59BD9B4E019))


@dataclass
class Block:
    """Texts that are worked on at once, or a piece of one text: ``opened`` says whether the first text begins here, ``ended`` whether the last one ends."""

    ids: list
    flags: list
    texts: list
    opened: bool = True
    ended: bool = True


def pieces(text: str, chars: int) -> Iterator[str]:
    """The text cut between words into pieces of at least ``chars`` characters, but for the last."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + chars)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _blocks(batches: Iterator[pa.RecordBatch], chars: int | None = None) -> Iterator[Block]:
    """Whole texts in blocks of about ``chars`` characters; a text of more than twice as many in pieces."""
    chars = chars or BLOCK_CHARS
    held, size = Block([], [], []), 0
    for batch in slices(batches):
        for one, flag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(text) > 2 * chars:
                last = None
                for n, piece in enumerate(pieces(text, chars)):
                    if last:
                        yield last
                    last = Block([one], [flag], [piece], n == 0, False)
                last.ended = True
                yield last
                continue
            held.ids.append(one)
            held.flags.append(flag)
            held.texts.append(text)
            size += len(text)
            if size >= chars:
                yield held
                held, size = Block([], [], []), 0
    if held.ids:
        yield held


class Tokens:
    """The tokens of blocks: words, then END; the context of a text's first token is END, of a later piece's the token before it."""

    def __init__(self):
        self.hasher, self.last = WordHasher(), END

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, its second half, its context, tokens of each text)."""
        h, g, counts = self.hasher(block.texts)
        if block.ended:
            at = np.cumsum(counts)
            h, g, counts = np.insert(h, at, END), np.insert(g, at, END_SECOND), counts + 1
        before = np.r_[END if block.opened else self.last, h[:-1]] if len(h) else h
        if len(h):
            self.last = h[-1]
        return h, g, before, counts


COUNTED = "bucket int, h array<long>, g array<long>, n array<int>"


def count_rows(order: int, h: np.ndarray, g: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of distinct items, sorted by hash, as one row for each bucket that has any; words and pairs have buckets of their own."""
    edges = np.searchsorted(h, np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
    edges = np.r_[edges, len(h)]
    filled = np.flatnonzero(np.diff(edges))
    for at in range(0, len(filled), 256):
        bucket = filled[at : at + 256]
        low, high = edges[bucket[0]], edges[bucket[-1] + 1]
        offsets = pa.array((np.r_[edges[bucket], high] - low).astype(np.int32))
        arrays = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x[low:high].astype(kind, copy=False)))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [pa.array((bucket + (order << BUCKET_BITS)).astype(np.int32)), arrays(h.view(np.int64), np.int64),
             pa.nulls(len(bucket), pa.list_(pa.int64())) if g is None else arrays(g.view(np.int64), np.int64), arrays(n, np.int32)], names=["bucket", "h", "g", "n"])


def count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (ord 1) and pairs (ord 2), summed over ``HELD_TOKENS`` tokens and the block that passes them."""
    tokens_of, pairs, words, held = Tokens(), [], [], 0

    def summed() -> Iterator[pa.RecordBatch]:
        # In place, as this is the most that a worker holds.
        h = np.concatenate(pairs)
        pairs.clear()
        h.sort()
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        yield from count_rows(2, h[first], None, np.diff(np.r_[first, len(h)]))
        h, g, n = (np.concatenate(x) for x in zip(*words, strict=True))
        words.clear()
        h, g, place = distinct(h, g)
        yield from count_rows(1, h, g, np.bincount(place, n, len(h)))

    for block in _blocks(batches):
        h, g, before, _ = tokens_of(block)
        first, second, place = distinct(h, g)
        pairs.append(pair_hash(before, h))
        words.append((first, second, np.bincount(place, minlength=len(first))))
        held += len(h)
        if held >= HELD_TOKENS:
            yield from summed()
            held = 0
    if held:
        yield from summed()


def block_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(56)).astype(np.int64)


def item_seeds(h: np.ndarray, order: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First probe and step of the item (h, level), before they are taken modulo a block's bits."""
    with np.errstate(over="ignore"):
        g = finalise(h + np.uint64((level * 2 + order) * 0xA24BAED4963EE407 % 2**64))
    return g, (g >> np.uint64(32)) | np.uint64(1)


def probe(g: np.ndarray, step: np.ndarray, i: int, block_bits: int) -> np.ndarray:
    """Bit place, within its block, of probe ``i``."""
    with np.errstate(over="ignore"):
        return ((g + np.uint64(i) * step) & np.uint64(block_bits - 1)).astype(np.int64)


def build_blocks(batches: Iterator[pa.RecordBatch], block_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (ord, h, level) of whole blocks to rows (block, bits)."""
    filled: dict[int, np.ndarray] = {}
    for batch in batches:
        order, h, level = (c.to_numpy() for c in batch.columns)
        h = h.view(np.uint64)
        blocks = block_of(h)
        for b in np.unique(blocks):
            bits = filled.setdefault(int(b), np.zeros(block_bits, bool))
            for o in (1, 2):
                held = (blocks == b) & (order == o)
                hashes, levels = h[held], level[held]
                for q in range(1, int(levels.max(initial=0)) + 1):
                    chosen = hashes[levels >= q if q > 1 else levels == 1]
                    g, step = item_seeds(chosen, o, q)
                    for i in range(PROBES):
                        bits[probe(g, step, i, block_bits)] = True
    for b, bits in filled.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])


class LogFrequencyFilter:
    """Levels of n-grams by repeated membership probes; ``cut`` has the least level held, by order, but one level more of pairs is held in the first ``part`` blocks."""

    def __init__(self, data: bytes, block_bits: int, max_level: int, cut: dict[int, int] | None = None, part: int = 0):
        self.bits = np.frombuffer(data, np.uint8)
        self.block_bits, self.max_level, self.cut, self.part = block_bits, max_level, cut or {1: 1, 2: 1}, part

    def least(self, h: np.ndarray, order: int) -> np.ndarray:
        """The least level that is held where ``h`` belongs."""
        return self.cut[order] - (block_of(h) < self.part) if order == 2 else np.full(len(h), self.cut[order])

    def _hits(self, h: np.ndarray, start: np.ndarray, left: np.ndarray, order: int, q: int) -> np.ndarray:
        """Those of the places ``left`` whose item of level ``q`` is held."""
        g, step = item_seeds(h[left], order, q)
        for i in range(PROBES):
            places = probe(g, step, i, self.block_bits) + start[left]
            hit = (self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            left, g, step = left[hit], g[hit], step[hit]
        return left

    def levels(self, h: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros(len(h), np.int16)
        left, start = np.arange(len(h)), block_of(h) * self.block_bits
        for q in range(2, self.max_level + 1):
            left = self._hits(h, start, left, order, q)
            if not len(left):
                break
            out[left] = q
        out[self._hits(h, start, np.flatnonzero((out == 0) & (self.least(h, order) == 1)), order, 1)] = 1
        return out


def token_levels(filter_: LogFrequencyFilter, tokens: np.ndarray, before: np.ndarray, words: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels in the filter of each token, its context and their pair; ``words``/``place`` are the distinct tokens and where each token is among them."""
    # The context of a token is the token before it, which only at the begin of a block may be none of ``words``.
    level = filter_.levels(np.r_[words, before[:1]], 1)
    follows = np.array_equal(before[1:], tokens[:-1])
    at = np.r_[len(words), place[:-1]] if follows and len(place) else np.searchsorted(words, before)
    at[:1] = len(words)
    return level[place], level[at], filter_.levels(pair_hash(before, tokens), 2)


def probabilities(model: dict, word: np.ndarray, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """log10 P of tokens by their level, that of the context and that of the pair; of no meaning where one is -1."""
    unigram = ((FLOORS + 0.5) / (model["mass"] + 0.5 * (model["types"] + 1)))[word]
    k = (model["weight"] * FLOORS / (FLOORS + model["kappa"]))[context]
    return np.log10((1 - k) * unigram + k * np.minimum(FLOORS[pair] / np.maximum(TOPS[context], 1), 1.0))


def bit_probabilities(model: dict, filter_: LogFrequencyFilter, tokens: np.ndarray, before: np.ndarray, words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 P of each token by the filter alone."""
    return probabilities(model, *token_levels(filter_, tokens, before, words, place))


def settled(level: np.ndarray, trained: np.ndarray, least: np.ndarray | int) -> np.ndarray:
    """Levels with -1 for those that the filter leaves open: not held, where not all is; what was trained on and is below level 2 was seen once."""
    return np.where((level > 0) | (np.asarray(least) == 1), level, np.where(trained & (np.asarray(least) == 2), 1, -1)).astype(np.int16)


def code_of(word, context, pair):
    """Three levels, each -1 to 126, as one number; of arrays or columns."""
    return (word + 1) + (context + 1) * 128 + (pair + 1) * 16_384


def _levels_of(code: Column) -> list[Column]:
    """The levels of word, context and pair in a code."""
    return [F.shiftright(code, at).bitwiseAND(127) - 1 for at in (0, 7, 14)]


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>, tail_g array<long>, tail_n array<long>, open array<long>, code array<int>, rare array<long>, rare_code array<int>, rare_w array<long>, rare_v array<long>"


def in_head(words: np.ndarray, second: np.ndarray, head: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(whether each word is among the broadcast ones, its count there or 0); ``head`` is sorted by both halves."""
    h, g, n = head
    known, count = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    if not len(h):
        return known, count
    at = np.searchsorted(h, words)
    left = np.arange(len(words))
    while len(left):
        left = left[at[left] < len(h)]
        left = left[h[at[left]] == words[left]]
        same = g[at[left]] == second[left]
        known[left[same]], count[left[same]] = True, n[at[left[same]]]
        # Another word with this first half: look at the next place.
        left = left[~same]
        at[left] += 1
    return known, count


def score_partition(batches: Iterator[pa.RecordBatch], model: dict, shared) -> Iterator[pa.RecordBatch]:
    """A row for each text; of a text in pieces one for each piece, of which the last has the sums and the others only their rare words and open tokens: ``open`` has those of which only the pair is open, ``rare`` those of which the word or its context is (0 where it is not)."""
    data, *head = shared.value
    filter_ = LogFrequencyFilter(data, model["block_bits"], model["max_level"], model["cut"], model["part"])
    head = tuple(np.frombuffer(x, t) for x, t in zip(head, (np.uint64, np.uint64, np.int64), strict=True))
    divisor = model["tokens"] + 0.5 * (model["types"] + 1)
    tokens_of, rid = Tokens(), TaskContext.get().partitionId() << 33
    carried = np.zeros(4)
    for block in _blocks(batches):
        tokens, second, before, counts = tokens_of(block)
        words, words_g, place = distinct(tokens, second)
        known, n = in_head(words, words_g, head)
        doc = np.repeat(np.arange(len(block.texts)), counts)
        is_known = known[place]
        base = np.where(is_known, np.log10((n[place] + 0.5) / divisor), 0.0)
        trained = ~np.array(block.flags, bool)[doc]
        level_w, level_v, level_p = token_levels(filter_, tokens, before, words, place)
        level_w, level_v = (settled(x, trained, model["cut"][1]) for x in (level_w, level_v))
        # A word that the filter leaves open may be among the broadcast ones; a context is the word before it, but for the block's first.
        exact = np.where(is_known, level_of(np.maximum(n, 1))[place], -1)
        level_w = np.where(level_w < 0, exact, level_w)
        level_v[1:] = np.where((level_v[1:] < 0) & (before[1:] == tokens[:-1]), exact[:-1], level_v[1:])
        both = pair_hash(before, tokens)
        level_p = settled(level_p, trained, filter_.least(both, 2))
        rare = (level_w < 0) | (level_v < 0)
        is_open = rare | (level_p < 0)
        score = probabilities(model, level_w, level_v, level_p)
        score[is_open] = 0.0
        code = code_of(level_w.astype(np.int32), level_v.astype(np.int32), level_p.astype(np.int32))
        left = []
        for chosen, columns in ((is_open & ~rare, (both, code)), (rare, (both, code, np.where(level_w < 0, tokens, np.uint64(0)), np.where(level_v < 0, before, np.uint64(0))))):
            at = np.flatnonzero(chosen)
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc[at], minlength=len(block.texts)))].astype(np.int32))
            left += [pa.ListArray.from_arrays(offsets, pa.array(x[at].view(np.int64) if x.dtype == np.uint64 else x[at])) for x in columns]
        total = lambda x: np.bincount(doc, x, len(block.texts))  # noqa: B023, E731
        sums = np.stack([counts.astype(np.float64), total(is_known), total(base), total(score)])
        if not block.opened:
            sums[:, 0] += carried
        carried = sums[:, -1]
        rest = np.flatnonzero(~is_known)
        # Distinct (text, word) among the rest, with how often each occurs.
        pairs, times = np.unique(doc[rest] * len(words) + place[rest], return_counts=True)
        of, word = np.divmod(pairs, max(len(words), 1))
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(block.texts)))].astype(np.int32))
        done = np.ones(len(block.texts), bool)
        done[-1:] = block.ended
        columns = [
            pa.array(np.arange(rid, rid + len(block.texts))), pa.array(block.ids, pa.int64()), pa.array(block.flags, pa.bool_()), pa.array(sums[0].astype(np.int64), mask=~done),
            pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]),
            *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (words[word].view(np.int64), words_g[word].view(np.int64), times.astype(np.int64))),
            *left,
        ]
        rid += len(block.texts) - (not block.ended)
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORED.split(", ")])


def _in_filter(cut: dict[int, int], part: int) -> Column:
    """Whether a row of the counts belongs into the filter."""
    more = (F.shiftrightunsigned("h", 56) < part).cast("int")
    return F.col("level") >= F.when(F.col("ord") == 1, cut[1]).otherwise(F.lit(cut[2]) - more)


def summed_counts(docs: DataFrame) -> DataFrame:
    """(ord, h, g, n) of all words and pairs of the texts; arrays are shuffled by bucket and taken apart only where they are added up."""
    partial = map_arrow(docs, count_partition, COUNTED).repartition("bucket")
    rows = partial.select("bucket", "g", "n", F.posexplode("h").alias("at", "one"))
    rows = rows.select("bucket", F.col("one").alias("h"), F.coalesce(F.get("g", F.col("at")), F.lit(0)).alias("g"), F.get("n", F.col("at")).alias("n"))
    return rows.groupBy("bucket", "h", "g").agg(F.sum("n").alias("n")).select(F.shiftright("bucket", BUCKET_BITS).cast("tinyint").alias("ord"), "h", "g", "n")


def train(docs: DataFrame, max_filter_bits: int = MAX_FILTER_BITS, head_words: int = HEAD_WORDS, weight: float = WEIGHT, kappa: float = KAPPA) -> tuple[dict, DataFrame, tuple]:
    """(model figures, n-gram counts, what is broadcast) from rows (doc_id, held_out, text), all of them training rows."""
    counts = released(summed_counts(docs).withColumn("level", _level_column("n")), "ngrams")
    levels = counts.groupBy("ord", "level").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("low")).collect()
    tokens, types = sum(r.n for r in levels if r.ord == 1), sum(r.k for r in levels if r.ord == 1)
    cut = {1: 1, 2: 1}
    top = max([r.level for r in levels], default=1)
    items = lambda: sum(r.k * max(r.level - 1, 1) for r in levels if r.level >= cut[r.ord])
    while items() * BITS_PER_ITEM > max_filter_bits and cut[1] <= top:
        cut[2 if cut[2] <= cut[1] else 1] += 1
    # The room that is left goes to the pairs of the next level, in whole blocks.
    below = sum(r.k * max(r.level - 1, 1) for r in levels if r.ord == 2 and r.level == cut[2] - 1)
    part = min(int(max(max_filter_bits / BITS_PER_ITEM - items(), 0) * BLOCKS // below), BLOCKS) if below else 0
    bits = BLOCKS * 64
    while bits < min(items() * BITS_PER_ITEM, max_filter_bits):
        bits *= 2
    block_bits = min(bits, max_filter_bits) // BLOCKS
    block = F.shiftrightunsigned("h", 56)
    below_filter = sum(r.k for r in levels if r.ord == 2 and r.level < cut[2])
    held = counts.filter(_in_filter(cut, part)).select("ord", "h", "level")
    blocks = map_arrow(held.repartition(block), lambda b: build_blocks(b, block_bits), "block int, bits binary").collect()
    empty = bytes(block_bits // 8)
    by_block = {r.block: bytes(r.bits) for r in blocks}
    data = b"".join([by_block.get(b, empty) for b in range(BLOCKS)])
    # The head: whole levels from the commonest down, as long as they fit.
    head, low = 0, top + 1
    for r in sorted((r for r in levels if r.ord == 1), key=lambda r: -r.level):
        if head + r.k > head_words:
            break
        head, low = head + r.k, r.level
    common = counts.filter(f"ord = 1 AND level >= {low}").select("h", "g", "n").toArrow()
    h, g, n = common.column(0).to_numpy().view(np.uint64), common.column(1).to_numpy().view(np.uint64), common.column(2).to_numpy()
    sort = np.lexsort((g, h))
    mass = sum(float(level_floor(r.level)) * r.k for r in levels if r.ord == 1)
    model = {"tokens": int(tokens), "types": int(types), "mass": mass, "block_bits": block_bits, "max_level": int(top), "weight": weight, "kappa": kappa, "head_level": low, "cut": cut, "part": part, "items": items(), "rows": sum(r.k for r in levels), "below": below_filter}
    return model, counts, (data, h[sort].tobytes(), g[sort].tobytes(), n[sort].astype(np.int64).tobytes())


def released(df: DataFrame, name: str) -> DataFrame:
    """``df`` materialised; the shuffle files that it took go at once, not when the driver next collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialise(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _rare_tokens(scored: DataFrame, counts: DataFrame, model: dict) -> DataFrame:
    """(rid, open, code) of the tokens of which the word or its context was open, with the levels of both."""
    tokens = scored.select("rid", F.inline(F.arrays_zip("rare", "rare_code", "rare_w", "rare_v"))).select("rid", F.col("rare").alias("open"), *(x.alias(f"level_{n}") for x, n in zip(_levels_of(F.col("rare_code")), "wvp", strict=True)), "rare_w", "rare_v")
    low = counts.filter(f"level < {model['cut'][1]} AND ord = 1").groupBy("h").agg(F.max("level").alias("low"))
    for slot in ("w", "v"):
        level, word = F.col(f"level_{slot}"), F.col(f"rare_{slot}")
        # A word that is known goes by the pair instead, so that such rows do not meet in one task.
        found = tokens.withColumn("h", F.when(level < 0, word).otherwise(F.col("open"))).join(low, "h", "left")
        tokens = found.withColumn(f"level_{slot}", F.when(level < 0, F.coalesce("low", F.lit(0))).otherwise(level)).drop("h", "low")
    return tokens.select("rid", "open", code_of(*(F.col(f"level_{n}") for n in "wvp")).cast("int").alias("code"))


def open_scores(scored: DataFrame, counts: DataFrame, model: dict) -> DataFrame:
    """(rid, open_score): log10 P of the tokens that the filter left open, summed by text; the levels that it does not hold are joined.

    The joins are made in rounds, each of a share of the pairs, so that the files of
    one round's shuffle hold no more rows than the counts do.
    """
    rare = released(_rare_tokens(scored, counts, model), "rare") if model["cut"][1] > 1 else None
    tokens = scored.select("rid", F.inline(F.arrays_zip("open", "code")))
    tokens = tokens.union(rare) if rare is not None else tokens
    pairs = counts.filter("ord = 2").filter(~_in_filter(model["cut"], model["part"])).select(F.col("h").alias("open"), F.col("level").alias("low"))
    moved = scored.agg(F.coalesce(F.sum(F.size("open") + F.size("rare")), F.lit(0))).first()[0] + model["below"]
    rounds = max(1, -(-moved // max(model["rows"], 1)))
    code_w, code_v, code_p = _levels_of(F.col("code"))
    level_p = F.when(code_p < 0, F.coalesce("low", F.lit(0))).otherwise(code_p)
    floor = _floor_column(code_v)
    unigram = (_floor_column(code_w) + 0.5) / F.lit(model["mass"] + 0.5 * (model["types"] + 1))
    k = F.lit(model["weight"]) * floor / (floor + F.lit(model["kappa"]))
    pair = F.least(_floor_column(level_p) / F.greatest(_top_column(code_v), F.lit(1.0)), F.lit(1.0))
    done = []
    for turn in range(rounds):
        share = F.pmod("open", F.lit(rounds)) == turn
        found = tokens.filter(share).join(pairs.filter(share), "open", "left")
        done.append(released(found.groupBy("rid").agg(F.sum(F.log10((1 - k) * unigram + k * pair)).alias("open_score")), "open"))
    return functools.reduce(DataFrame.union, done).groupBy("rid").agg(F.sum("open_score").alias("open_score"))


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, text): held out where crc32 of the id as text leaves 1 modulo 5 (a null id counts as empty text)."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc % 5 == 1).alias("held_out"), text_or_empty(text_col).alias("text"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Train on the rows that are not held out and score all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score for each row. A null or empty text has one token, the end. Null ids
    count as the empty text when folds are dealt. Repeated rows count and are
    scored as often as they occur. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = flagged(docs, id_col, text_col)
    model, counts, shared = train(rows.filter("NOT held_out"), **options)
    sent = spark.sparkContext.broadcast(shared)
    scored = materialise(map_arrow(rows, lambda b: score_partition(b, model, sent), SCORED), "scored")
    tail = scored.select("rid", F.inline(F.arrays_zip("tail", "tail_g", "tail_n"))).select("rid", F.col("tail").alias("h"), F.col("tail_g").alias("g"), F.col("tail_n").alias("m"))
    known = counts.filter(f"ord = 1 AND level < {model['head_level']}").select("h", "g", "n")
    divisor = model["tokens"] + 0.5 * (model["types"] + 1)
    n = F.coalesce("n", F.lit(0))
    rest = tail.join(known, ["h", "g"], "left").groupBy("rid").agg(
        F.sum(F.col("m") * F.log10((n + 0.5) / F.lit(divisor))).alias("rest"), F.sum(F.when(n > 0, F.col("m")).otherwise(0)).alias("rest_known"))
    whole = scored.filter("n_tokens IS NOT NULL").select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(rest, "rid", "left")
    if max(model["cut"].values()) > 1:
        whole = whole.join(open_scores(scored, counts, model), "rid", "left")
    else:
        whole = whole.withColumn("open_score", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("open_score", F.lit(0.0))).alias("score"))


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
