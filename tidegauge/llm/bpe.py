"""Byte-level BPE by DuckDB recursive queries in each partition (operator 8).

A worker keeps an in-process DuckDB with two tables: ``merges`` (a pair of ids, the
merged id; a pair's rank is its merged id) and ``vocab`` (id, bytes). The
distinct pieces of a block of texts become token-position rows; a recursive
query contracts each word's leftmost minimum-rank pair until no pair of the
word is in the merge table. An ordered aggregation over positions decodes the
ids through ``vocab``. Pieces seen before come from a bounded memo of these same
results; when it is full, those that were asked for again stay.

A word of n bytes takes up to n rounds over its rows. Pieces of more than
``LONG_PIECE`` bytes (rare: unbroken runs) therefore take a second recursion,
which contracts all occurrences of the least pair in a round where that gives the
same result: no pair with the merged token ranks below it. A round costs about
20 ms however it is written, so runs of more than ``HUGE_PIECE`` bytes (of 20,000
random letters: 30 s) take the same contraction from a heap (0.05 s).
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import SLICE_ROWS, map_arrow, slices, table, text_or_empty
from tidegauge.llm.pretokens import ranks, splitter, vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes above which a piece takes the recursion of long pieces, and above which the heap.
LONG_PIECE, HUGE_PIECE = 96, 4_000
#: Pieces a worker remembers (about 120 MB); more only if one text has more.
CACHE_PIECES = 300_000
DUCKDB_MEMORY = "256MB"

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Words to their final ids. A round unnests each word into token-position rows, joins adjacent tokens with the
#: merge table, and contracts the pair of least rank, the leftmost of equals. The last round of a word is its result.
ENCODE = """
WITH RECURSIVE run(word, toks, step) AS (
  SELECT word, toks, 0 FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT word, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[:-2], 1) AS pos
     FROM run WHERE len(toks) > 1),
   best AS (
     SELECT p.word, min(m.merged::BIGINT * 4096 + p.pos) AS b
     FROM pairs p JOIN merges m ON m.pair = p.l::BIGINT * 65536 + p.r GROUP BY p.word)
   SELECT r.word, r.toks[:(b % 4096) - 1] || [(b // 4096)::INTEGER] || r.toks[(b % 4096) + 2:], r.step + 1
   FROM run r JOIN best USING (word))
)
SELECT word, arg_max(toks, step) AS toks FROM run GROUP BY word
"""

#: As ``ENCODE``, for long words: every occurrence of the least pair at once, leftmost first and without overlap (every
#: other one of a run of neighbours), if its token is ``plain``; else the leftmost. Only the newest row of a word is kept.
ENCODE_LONG = """
WITH RECURSIVE run(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM start
  UNION
  (WITH pairs AS (
     SELECT word, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[:-2], 1) AS pos
     FROM run WHERE len(toks) > 1),
   ranked AS (
     SELECT p.word, p.pos, m.merged, m.plain FROM pairs p JOIN merges m ON m.pair = p.l::BIGINT * 65536 + p.r),
   least AS (SELECT word, min(merged) AS merged, min_by(pos, (merged, pos)) AS first FROM ranked GROUP BY word),
   hits AS (
     SELECT r.word, r.pos, r.merged, row_number() OVER (PARTITION BY r.word ORDER BY r.pos) AS n
     FROM ranked r JOIN least l ON l.word = r.word AND l.merged = r.merged WHERE r.plain OR r.pos = l.first),
   places AS (SELECT word, pos, merged, row_number() OVER (PARTITION BY word, pos - n ORDER BY pos) AS k FROM hits),
   picked AS (SELECT word, pos, merged FROM places WHERE k % 2 = 1),
   held AS (
     SELECT r.word, unnest(r.toks) AS tok, generate_subscripts(r.toks, 1) AS pos FROM run r SEMI JOIN least USING (word))
   SELECT h.word, list(coalesce(p.merged, h.tok) ORDER BY h.pos)
   FROM held h LEFT JOIN picked p ON p.word = h.word AND p.pos = h.pos
   ANTI JOIN picked q ON q.word = h.word AND q.pos = h.pos - 1 GROUP BY h.word)
)
SELECT word, toks FROM run
"""

#: The ids of a word as text, and by an ordered aggregation the bytes that they stand for (hexadecimal).
COLLECT = """
SELECT word, array_to_string(toks, ' ') AS ids, len(toks) AS n, hex
FROM final JOIN (
  SELECT f.word, string_agg(v.hex, '' ORDER BY f.pos) AS hex
  FROM (SELECT word, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM final) f
  JOIN vocab v ON v.id = f.tok GROUP BY f.word) USING (word)
"""


def merge_rows(vocab: dict[bytes, int]) -> Iterator[tuple[int, int]]:
    """Every (pair, merged): ``pair`` packs two ids whose bytes join to a token's."""
    for whole, rank in vocab.items():
        for cut in range(1, len(whole)):
            left, right = vocab.get(whole[:cut]), vocab.get(whole[cut:])
            if left is not None and right is not None:
                yield left * 65536 + right, rank


def plain_tokens(rows: list[tuple[int, int]]) -> set[int]:
    """Merged ids below which no pair that they are part of ranks."""
    found = {merged for _, merged in rows}
    for pair, merged in rows:
        found -= {part for part in divmod(pair, 65536) if merged < part}
    return found


def heap_encode(data: bytes, vocab: dict[bytes, int]) -> list[int]:
    """Contract the leftmost minimum-rank pair until none is left, by a heap of (rank, place)."""
    n = len(data)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := vocab.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        ends[i], alive[j], after[i] = end, False, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := vocab.get(data[i : ends[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, ends[after[j]]))
        if before[i] >= 0 and (r := vocab.get(data[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(vocab[data[i : ends[i]]])
        i = after[i]
    return out


class DuckBpe:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str):
        import duckdb

        self.vocab = ranks(path)
        self.single = [self.vocab[bytes([b])] for b in range(256)]
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        #: Results by piece, and the pieces that a later span of texts asked for again.
        self.memo: dict[str, tuple[str, int, bytes]] = {}
        self.again: set[str] = set()
        # What does not fit goes to the task's own scratch folder, and is of no use to any other.
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": tempfile.gettempdir()})
        merges = list(merge_rows(self.vocab))
        plain = plain_tokens(merges)
        self._load("merges", [("pair", pa.int64()), ("merged", pa.int32()), ("plain", pa.bool_())], zip(*((p, m, m in plain) for p, m in merges), strict=True))
        ids = sorted(self.bytes_of)
        self._load("vocab", [("id", pa.int32()), ("hex", pa.string())], (ids, [self.bytes_of[i].hex() for i in ids]))

    def _load(self, name: str, fields: list, columns) -> None:
        held = pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
        self.con.register("incoming", held)
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def make_room(self, used: set[str], fresh: set[str]) -> None:
        """Forget, where ``fresh`` would not fit, the pieces that were asked for once only; if that is too little, all but the ``used`` ones."""
        self.again |= used - fresh
        if len(self.memo) + len(fresh) > CACHE_PIECES:
            kept = self.again if len(self.again) + len(fresh) <= CACHE_PIECES * 3 // 4 else used - fresh
            self.memo = {p: self.memo[p] for p in kept}
            self.again = set()

    def learn(self, pieces: list[str]) -> None:
        """Put (ids as text, count, decoded bytes) of each piece into the memo."""
        coded = [p.encode() for p in pieces]
        single, size = self.single, [len(c) for c in coded]
        for query, low, high in ((ENCODE, 0, LONG_PIECE), (ENCODE_LONG, LONG_PIECE, HUGE_PIECE)):
            some = [n for n, k in enumerate(size) if low < k <= high]
            if some:
                self._load("start", [("word", pa.int32()), ("toks", pa.list_(pa.int32()))], (some, [[single[b] for b in coded[n]] for n in some]))
                self.con.execute(f"CREATE OR REPLACE TEMP TABLE final AS {query}")
                for word, ids, n, hexed in self.con.execute(COLLECT).fetchall():
                    self.memo[pieces[word]] = (ids, n, bytes.fromhex(hexed))
        for n, c in enumerate(coded):
            if size[n] > HUGE_PIECE:
                ids = heap_encode(c, self.vocab)
                self.memo[pieces[n]] = (" ".join(map(str, ids)), len(ids), b"".join([self.bytes_of[i] for i in ids]))


#: One encoder a worker process, so that its tables and memo serve later tasks too.
_WORKER: dict[str, DuckBpe] = {}


def _encoder(path: str) -> DuckBpe:
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = DuckBpe(path)
    return _WORKER[path]


def _blocks(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """Rows in blocks of at least ``chars`` characters, so that one recursion serves many texts."""
    ids, texts, size = [], [], 0
    for batch in slices(batches, SLICE_ROWS):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode_partition(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, n_tokens, digests), or with ``keep`` of (doc_id, ids, decoded)."""
    # Nothing here makes cycles, and a collection walks through every piece of a block and of the memo.
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield from _encode_blocks(_blocks(batches), path, keep)
    finally:
        if collecting:
            gc.enable()


def _encode_blocks(blocks: Iterator[tuple[list, list]], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    bpe, split = _encoder(path), splitter()
    for doc_ids, texts in blocks:
        at = 0
        out: list[tuple] = []
        pieces = [split(t) for t in texts]
        while at < len(texts):
            # As many texts as the memo can serve at once.
            used: set[str] = set()
            fresh: set[str] = set()
            upto = at
            while upto < len(texts) and (upto == at or len(fresh) < CACHE_PIECES // 4):
                here = set(pieces[upto]).difference(used)
                fresh |= here.difference(bpe.memo)
                used |= here
                upto += 1
            bpe.make_room(used, fresh)
            if fresh:
                bpe.learn(list(fresh))
            find = bpe.memo.__getitem__
            for k in range(at, upto):
                ids, counts, decoded = zip(*map(find, pieces[k]), strict=True) if pieces[k] else ((), (), ())
                ids, decoded = " ".join(ids), b"".join(decoded)
                if keep:
                    out.append((doc_ids[k], [int(x) for x in ids.split()], decoded))
                else:
                    out.append((doc_ids[k], sum(counts), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            at = upto
        cols = list(zip(*out, strict=True))
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.binary())], names=["doc_id", "ids", "decoded"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary) of every text.

    A null or empty text has no ids. Null ids stay null, repeated rows are
    encoded one by one, an empty table gives no rows, other columns are
    ignored. No shuffle; a worker's memory is bounded by the memo, DuckDB's
    limit and one block of texts.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)
    return map_arrow(_chosen(docs, id_col, text_col), lambda b: encode_partition(b, path, True), "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, but only token counts and the digests of ids and decoded bytes leave the workers."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    return map_arrow(_chosen(docs, id_col, text_col), lambda b: encode_partition(b, path, False), SCHEMA)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
