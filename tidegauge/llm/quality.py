"""Quality by importance resampling of hashed n-gram models (operator 4).

Texts are split into words and runs of punctuation; unigrams and bigrams are
hashed into ``BUCKETS`` buckets. Two generative models are fitted: ``target``
on labelled good documents (a bounded sample of labelled rows) and ``raw`` on
all documents. A document's log weight is the log of its probability under
``target`` over that under ``raw``; adding a Gumbel variate (from a hash of the
document's id, so that it is the same in every run) and taking the k greatest
samples k documents without replacement in proportion to their weights.

k is a number of documents that is set before any is scored. ``resample`` takes
it; unless given it is the share of good ones among the labelled rows, with
``SPARE`` standard errors on top so that clean documents stay, of all documents.
The k-th greatest score is found by counting scores in bins of a narrowing
range, so there is no global sort.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidegauge.llm.common import map_arrow, materialise, packed, ref, slices, table, text_or_empty, unpacked
from tidegauge.llm.pretokens import BoundedCache
from tidegauge.llm.word_hash import finalise

BUCKETS = 10_000
#: At most so many labelled rows are used, chosen by a hash of their id.
LABELLED_ROWS = 20_000
#: Standard errors of the labelled share of good documents by which k exceeds it.
SPARE = 1.0
#: The target model's prior, in counts a bucket, is dealt out as the raw model has it, so that buckets without
#: evidence tell for neither model.
SMOOTHING = 1.0
SEED = 17
CACHE_TOKENS = 150_000

_TOKENS = 150_000

#: What a token equal to the one before it reads as.
AGAIN = np.uint64(0x2545F4914F6CDD1D)
_TOKENS = re.compile(r"\w+|[^\w\s]+")


class BucketCounts:
    """Bucket numbers of a text's unigrams and bigrams."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = np.uint64(buckets)
        self.memo = BoundedCache(CACHE_TOKENS, _hash)

    def __call__(self, text: str) -> np.ndarray:
        tokens = _TOKENS.findall(text.lower())
        h = np.fromiter(map(self.memo.__getitem__, tokens), np.uint64, len(tokens))
        with np.errstate(over="ignore"):
            pairs = finalise(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        return np.concatenate([h, pairs]) % self.buckets


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token, 3)


def sampled_labels(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, good) of at most ``rows`` labelled rows, the least by a hash of the id; a document labelled both ways is bad."""
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _fit_partition(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Bucket counts of this partition: all of its texts, and the labelled good ones."""
    of = BucketCounts(buckets)
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for batch in slices(batches):
        for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.bincount(of(text).astype(np.int64), minlength=buckets)
            raw += counts
            if good:
                target += counts
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) of each bucket. ``sample`` has doc_id and good; it is bounded, so it is broadcast to the documents."""
    rows = docs.select(ref("doc_id").alias("doc_id"), text_or_empty("text").alias("text")).join(F.broadcast(sample), "doc_id", "left").select("text", "good")
    counts = map_arrow(rows, lambda b: _fit_partition(b, buckets), "bucket long, raw long, target long")
    summed = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = summed.column(0).to_numpy()
    raw[at], target[at] = summed.column(1).to_numpy(), summed.column(2).to_numpy()
    return _log_ratio(target, raw)


def _log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    share = (raw + 1) / (raw + 1).sum()
    prior = SMOOTHING * len(raw)
    return np.log((target + prior * share) / (target.sum() + prior)) - np.log(share)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A standard Gumbel variate from a hash of the id; a null id has the variate of its own hash."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def weigh(docs: DataFrame, ratio: np.ndarray, carried: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``carried`` columns of ``docs`` (all, unless given) packed in ``row``, with the log weight and the Gumbel-perturbed score."""
    buckets = len(ratio)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, values = BucketCounts(buckets), sent.value
        for batch in slices(batches):
            sums = [float(values[of(t).astype(np.int64)].sum()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], names=["row", "log_weight"])

    rows = docs.select(packed(carried or docs.columns).alias("row"), text_or_empty(text_col).alias("text"))
    weighed = map_arrow(rows, run, StructType([rows.schema["row"], StructField("log_weight", DoubleType())]))
    return weighed.withColumn("score", F.col("log_weight") + gumbel(F.col("row")[id_col]))


def kth_greatest(scored: DataFrame, k: int, column: str = "score", bins: int = 4_096, few: int = 10_000) -> float:
    """The k-th greatest value (the least of all where there are fewer; infinite for k under 1).

    Each round counts the values of the range left in at most ``bins`` bins and
    keeps the bin that the k-th lies in; at most ``few`` values come to the driver.
    """
    ends = scored.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n")).first()
    if k < 1 or not ends.n:
        return np.inf
    low, high, n, k = ends.low, ends.high, ends.n, min(k, ends.n)
    while low < high:
        part = scored.filter(F.col(column).between(low, high)).select(F.col(column).alias("x"))
        if n <= few:
            return sorted((r.x for r in part.collect()), reverse=True)[k - 1]
        place = F.least(F.floor((F.col("x") - low) / ((high - low) / bins)), F.lit(bins - 1))
        for r in part.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy(F.desc("bin")).collect():
            if k <= r.n:
                low, high, n = r.low, r.high, r.n
                break
            k -= r.n
    return low


def size_of_sample(documents: int, labelled: int, good: int, spare: float = SPARE) -> int:
    """k for so many documents, from the labelled share of good ones; all where no or only good rows are labelled, or none is good."""
    if not 0 < good < labelled:
        return documents
    share = good / labelled
    return min(documents, math.ceil(documents * (share + spare * math.sqrt(share * (1 - share) / labelled))))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, carried: list[str] | None = None, buckets: int = BUCKETS, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """``row`` (the ``carried`` columns of ``docs``; all, unless given), log_weight, score, k, and ``kept``: whether the score is among the k greatest.

    Null and empty texts have weight 0, a text without a word likewise; scores
    equal to the k-th greatest are all kept. Repeated rows with one id share a
    Gumbel variate. Without usable labels, and without k, every document is
    kept. Documents need ``doc_id`` and ``text``; other columns, whatever their
    names, are carried through.
    """
    sample = sampled_labels(labels, labelled_rows)
    known = sample.toArrow()
    local = docs.sparkSession.createDataFrame(known).toDF("doc_id", "good") if known.num_rows else sample
    ratio = fit(docs, local, buckets)
    # Scored once: the k-th greatest score and the choice read this table.
    scored = materialise(weigh(docs, ratio, carried), "weighed")
    if k is None:
        k = size_of_sample(scored.count(), known.num_rows, sum(g for g in known.column(1).to_pylist() if g))
    return scored.withColumns({"k": F.lit(k).cast("long"), "kept": F.col("score") >= F.lit(float(kth_greatest(scored, k)))})


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The documents that the resampling keeps, with their own columns."""
    kept = resample(docs, labels, k).filter("kept")
    return kept.select(unpacked(docs.columns))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carried=["doc_id"])
    return judged.select(F.col("row.doc_id").alias("doc_id"), "log_weight", "score", "k", "kept")
