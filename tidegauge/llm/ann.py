"""Nearest neighbours by inner product with an adaptive dimension scan (operator 5).

Index. Largest inner product becomes smallest distance by one more dimension,
``sqrt(M**2 - |x|**2)`` with M the greatest norm (0 for queries). Centroids are
fitted on a bounded sample; every row is assigned to its nearest centroid's
list. Vectors are turned by one random rotation, so that the first d of D
dimensions are a fair sample of the distance.

Search. Each probed list is scanned in blocks of columns. After d dimensions a
candidate is abandoned when the hypothesis that it is within the query's bound
r is rejected: ``sqrt(D/d) * partial > (1 + EPSILON/sqrt(d)) * r``. A query's
``FIRST_LISTS`` nearest lists are scanned first, bound by its k-th nearest among
``ANCHORS`` rows; the others are bound by the k-th nearest found by then, so
they give few candidates. Survivors (and the anchors themselves) get their exact
inner product on the original vectors in double precision.

How many lists are probed is measured, not guessed: for a bounded sample of
queries the exact neighbours among all rows are found, and the least number of
lists that holds ``RECALL`` of them is taken.

Balance. A list is dealt into chunks of about ``CHUNK`` vectors and the queries
that probe it into blocks of about ``QUERY_BLOCK``, so neither a hot vector nor
a hot list makes a large task. What comes to the driver is bounded: the sample,
one row a list, and the neighbours of the measured queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import map_arrow, materialise, table
from tidegauge.session import ship

K = 20
QUERY_STEP = 20
#: Rows that centroids are fitted on, rows whose nearest bound a query's search, queries whose recall is measured.
FIT_ROWS, ANCHORS, MEASURED = 20_000, 1_024, 256
MAX_LISTS = 2_048
RECALL = 0.97
FIRST_LISTS = 8
EPSILON = 2.1
FIRST_BLOCK, BLOCK = 16, 16
CHUNK, QUERY_BLOCK = 2_048, 4_096
SEED = 7

FOUND = "query_id long, vec_id long, score double"


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): vectors of the commonest length without null, non-finite or only zero components; null ids take no part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(finite & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length.n if length else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _vectors(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows; the one place where results get their scores."""
    return np.einsum("ij,ij->i", a, b)


def nearest_centroids(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    d = (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T
    if n >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    part = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def k_means(x: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:lists]].copy()
    for _ in range(rounds):
        at = nearest_centroids(x, centroids, 1)[:, 0]
        n = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


class Index:
    """What every worker needs: the rotation, the centroids, the greatest norm and the anchors. Bounded by the constants above."""

    def __init__(self, sample_ids: np.ndarray, sample: np.ndarray, greatest: float, rows: int):
        self.dim, self.greatest = sample.shape[1], greatest
        rng = np.random.default_rng(SEED)
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim + 1, self.dim + 1)))[0]
        lists = int(min(MAX_LISTS, max(1, rows**0.5), max(1, len(sample) // 8)))
        self.centroids = k_means(self.stored(sample), lists)
        self.anchor_ids, self.anchors = sample_ids[:ANCHORS], sample[:ANCHORS]
        self.turned_anchors = self.stored(self.anchors)

    def stored(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.greatest - (x**2).sum(1), 0))
        return np.concatenate([x, more[:, None]], axis=1) @ self.rotation

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ self.rotation

    def anchored(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, tuple]:
        """(bound on the squared distance of each query's k-th nearest, the nearest anchors as found rows)."""
        turned = self.asked(q)
        d = (turned**2).sum(1)[:, None] + (self.turned_anchors**2).sum(1)[None, :] - 2 * turned @ self.turned_anchors.T
        d = np.where(ids[:, None] == self.anchor_ids[None, :], np.inf, d)
        n = min(k, d.shape[1])
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        near = np.take_along_axis(d, part, 1)
        bound = near.max(1) if n == k else np.full(len(q), np.inf)
        who = np.repeat(np.arange(len(q)), n)
        at, fine = part.ravel(), np.isfinite(near.ravel())
        who, at = who[fine], at[fine]
        return bound * (1 + 1e-9) + 1e-12, (ids[who], self.anchor_ids[at], scores(q[who], self.anchors[at]))


def scan(q: np.ndarray, bound: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places that survive the column-block scan of turned vectors; ``bound`` is squared."""
    whole = x.shape[1]
    d = min(FIRST_BLOCK, whole)
    partial = (q[:, :d] ** 2).sum(1)[:, None] + (x[:, :d] ** 2).sum(1)[None, :] - 2 * q[:, :d] @ x[:, :d].T
    limit = lambda d: bound * (1 + EPSILON / d**0.5) ** 2 * d / whole if d < whole else bound
    who, at = np.nonzero(partial <= limit(d)[:, None] + 1e-9)
    left = partial[who, at]
    while d < whole and len(who):
        upto = min(d + BLOCK, whole)
        left = left + ((q[who, d:upto] - x[at, d:upto]) ** 2).sum(1)
        d = upto
        fine = left <= limit(d)[who] + 1e-9
        who, at, left = who[fine], at[fine], left[fine]
    return who, at


def best(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each ``who``: greatest score, then least id."""
    order = np.lexsort((ids, -score, who))
    w = who[order]
    starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
    rank = np.arange(len(w)) - np.repeat(starts, np.diff(np.r_[starts, len(w)]))
    return order[rank < k]


def _found(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(embeddings: DataFrame, k: int = K, query_step: int = QUERY_STEP, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, nearest first, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``query_step``; candidates
    are all rows but those with the query's own id. Rows that ``usable`` leaves
    out take no part. Rows repeated under one id count once, at the best of their
    scores; as a query they are the least of their vectors. A query with
    fewer than k candidates gets all of them; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, id_col, vector_col)
    totals = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    if not totals.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = totals.d
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(FIT_ROWS).toArrow().combine_chunks()
    ids = sample.column(0).to_numpy()
    index = Index(ids, _matrix(sample.column(1).combine_chunks() if isinstance(sample.column(1), pa.ChunkedArray) else sample.column(1), dim), totals.m, totals.n)
    sent = spark.sparkContext.broadcast(index)
    ship(spark)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            at = nearest_centroids(sent.value.stored(x), sent.value.centroids, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), batch.column(1)], names=["list", "vec_id", "v"])

    indexed = materialise(map_arrow(rows, assign, "list int, vec_id long, v array<double>"), "lists")
    asked = indexed.filter(F.col("vec_id") % query_step == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    probes = _measured_probes(indexed, asked, index, k, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            q = _matrix(batch.column(1), dim)
            at = nearest_centroids(index.asked(q), index.centroids, probes) if len(q) else np.zeros((0, probes), np.int64)
            who, place = np.repeat(np.arange(len(q)), at.shape[1]), np.tile(np.arange(at.shape[1]), len(q))
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel(), pa.int32()), pa.array(place, pa.int32()), batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who))], names=["list", "place", "query_id", "v"])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _found(*sent.value.anchored(batch.column(0).to_numpy(), _matrix(batch.column(1), dim), k)[1])

    routed = map_arrow(asked, route, "list int, place int, query_id long, v array<double>")
    near = _scan_lists(indexed, routed.filter(F.col("place") < FIRST_LISTS).withColumn("kth", F.lit(None).cast("double")), sent, dim, k)
    first = materialise(_top(near.unionByName(map_arrow(asked, anchors, FOUND)), k), "nearest")
    if probes > FIRST_LISTS:
        kth = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        rest = _scan_lists(indexed, routed.filter(F.col("place") >= FIRST_LISTS).join(kth, "query_id", "left"), sent, dim, k)
        first = _top(first.select("query_id", "vec_id", "score").unionByName(rest), k)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan_lists(indexed: DataFrame, routed: DataFrame, sent, dim: int, k: int) -> DataFrame:
    """The k best that each cell has for each of its queries; ``routed`` has list, query_id, v and kth, the k-th best score known so far (or null)."""
    spark = indexed.sparkSession
    # One row a list: sizes of both sides, from which the grid of chunks and query blocks follows.
    sizes = indexed.groupBy("list").agg(F.count("*").alias("n")).join(routed.groupBy("list").agg(F.count("*").alias("q")), "list")
    sizes = sizes.select("list", F.ceil(F.col("n") / CHUNK).alias("chunks"), F.ceil(F.col("q") / QUERY_BLOCK).alias("blocks"))
    grid = F.broadcast(spark.createDataFrame(sizes.toArrow()))
    stored = indexed.join(grid, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
    queries = routed.join(grid, "list").select(
        "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("query_id"), "blocks").alias("block"), "query_id", "v", "kth")
    cell = ["list", "chunk", "block"]

    def scan_cell(base: pa.Table, ask: pa.Table) -> pa.Table:
        index = sent.value
        out = []
        if base.num_rows and ask.num_rows:
            vec_ids, x = base.column("vec_id").to_numpy(), _matrix(base.column("v").combine_chunks(), dim)
            turned = index.stored(x)
            q_ids, q = ask.column("query_id").to_numpy(), _matrix(ask.column("v").combine_chunks(), dim)
            kth = ask.column("kth").cast(pa.float64()).fill_null(float("nan")).to_numpy()
            for at in range(0, len(q), 256):
                part, ids, known = q[at : at + 256], q_ids[at : at + 256], kth[at : at + 256]
                # Stored vectors all have the greatest norm, so a score is a distance.
                bound = (part**2).sum(1) + index.greatest - 2 * known + 1e-9
                missing = np.isnan(known)
                if missing.any():
                    bound[missing] = index.anchored(ids[missing], part[missing], k)[0]
                who, place = scan(index.asked(part), bound, turned)
                other = ids[who] != vec_ids[place]
                who, place = who[other], place[other]
                score = scores(part[who], x[place])
                chosen = best(who, vec_ids[place], score, k)
                out.append(_found(ids[who[chosen]], vec_ids[place[chosen]], score[chosen]))
        return pa.Table.from_batches(out, schema=_found(np.zeros(0), np.zeros(0), np.zeros(0)).schema)

    return stored.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(scan_cell, FOUND)


def exact(indexed: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score, list, rank of a bounded set of queries against every row."""
    dim = q.shape[1]
    sent = indexed.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        for batch in batches:
            lists, vec_ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dim)
            s = np.where(ids[:, None] == vec_ids[None, :], -np.inf, asked @ x.T)
            n = min(k, s.shape[1])
            part = np.argpartition(-s, n - 1, axis=1)[:, :n] if n else np.zeros((len(ids), 0), np.int64)
            # Ties with the last one kept may be left out here; they are equally near, so the measure stands.
            who, at = np.repeat(np.arange(len(ids)), n), part.ravel()
            fine = np.isfinite(s[who, at])
            who, at = who[fine], at[fine]
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(vec_ids[at]), pa.array(scores(asked[who], x[at])), pa.array(lists[at])], names=["query_id", "vec_id", "score", "list"])

    near = map_arrow(indexed.select("list", "vec_id", "v"), run, FOUND + ", list int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _measured_probes(indexed: DataFrame, asked: DataFrame, index: Index, k: int, recall: float) -> int:
    """The least number of lists that holds ``recall`` of the exact neighbours of a bounded sample of the queries."""
    sample = asked.orderBy(F.xxhash64("query_id", F.lit(SEED + 1)), "query_id").limit(MEASURED).toArrow()
    if not sample.num_rows:
        return 1
    ids, q = sample.column(0).to_numpy(), _matrix(sample.column(1).combine_chunks(), index.dim)
    near = exact(indexed, ids, q, k).select("query_id", "list").toArrow()
    if not near.num_rows:
        return 1
    order = nearest_centroids(index.asked(q), index.centroids, len(index.centroids))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
    place = {int(i): n for n, i in enumerate(ids)}
    depth = np.sort([rank[place[i], at] for i, at in zip(near.column(0).to_pylist(), near.column(1).to_pylist(), strict=True)])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1


def op5_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
