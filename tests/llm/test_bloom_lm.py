"""Operator 10: exact base scores, the filter's one-sided error, probabilities that do not sum above one."""

import collections
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import bloom_lm as lm
from tidegauge.llm import word_hash
from tidegauge.llm.word_hash import WordHasher


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


@pytest.mark.parametrize("head", [0, 10, lm.HEAD_WORDS])
def test_base_scores(spark, docs, texts, head):
    rows = lm.score_documents(docs, head_words=head).collect()
    counts = collections.Counter(t for i, x in texts if not held_out(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held_out(i), len(w := tokens(x)), sum(counts[t] > 0 for t in w), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w), 6)) for i, x in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want


def test_better_than_base_on_unseen_text(spark, sf_dir):
    rows = [r for r in lm.op10_bloom_lm(spark, sf_dir.replace("sf0.001", "sf0.01")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.score < 0 for r in rows)


def exact_scores(rows):
    """Each text's score by exact levels of every word and pair."""
    def level(n):
        return int(math.floor(math.log(n) / math.log(lm.BASE) + 1e-9)) + 1 if n else 0

    seen = [tokens(x) for i, x in rows if not held_out(i)]
    ones = collections.Counter(t for w in seen for t in w)
    twos = collections.Counter(p for w in seen for p in zip([None, *w], w, strict=False))
    mass = sum(float(lm.level_floor(level(n))) for n in ones.values())

    def one(v, w):
        floor, top = float(lm.level_floor(level(ones[v]))), max(float(lm.level_top(level(ones[v]))), 1.0)
        k = lm.WEIGHT * floor / (floor + lm.KAPPA)
        unigram = (float(lm.level_floor(level(ones[w]))) + 0.5) / (mass + 0.5 * (len(ones) + 1))
        return math.log10((1 - k) * unigram + k * min(float(lm.level_floor(level(twos[v, w]))) / top, 1.0))

    return [(str(i), round(sum(one(v, w) for v, w in zip([None, *tokens(x)], tokens(x), strict=False)), 5)) for i, x in rows]


@pytest.mark.parametrize("bits", [0, 3_000, lm.MAX_FILTER_BITS])
def test_what_the_filter_does_not_hold_is_scored_exactly(spark, docs, texts, bits, monkeypatch):
    """Of no words and pairs, of the commonest or of all in the filter, every count reaches the score; so large an item has no false positives."""
    if bits < lm.MAX_FILTER_BITS:
        monkeypatch.setattr(lm, "BITS_PER_ITEM", 1_000)
    rows = lm.score_documents(docs, max_filter_bits=max(bits * 1_000, lm.BLOCKS * 8)).collect()
    got, want = (sorted(x) for x in ([(str(r.doc_id), round(r.score, 5)) for r in rows], exact_scores(texts)))
    if bits < lm.MAX_FILTER_BITS:
        assert got == want
    else:
        assert sum(a == b for a, b in zip(got, want, strict=True)) > 0.5 * len(want)


def test_trained_tokens_outside_the_filter_were_seen_once():
    level, trained = np.array([0, 0, 3], np.int16), np.array([True, False, False])
    assert [lm.settled(level, trained, cut).tolist() for cut in (1, 2, 3)] == [[0, 0, 3], [1, -1, 3], [-1, -1, 3]]
    assert lm.settled(level, trained, np.array([1, 2, 2])).tolist() == [0, -1, 3]


def counted(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], names=["doc_id", "held_out", "text"])
    rows = [r for b in lm.count_partition(iter([batch])) for r in b.to_pylist()]
    return [r | {"ord": r["bucket"] >> lm.BUCKET_BITS, "bucket": r["bucket"] % (1 << lm.BUCKET_BITS)} for r in rows]


def test_a_worker_sends_each_count_once(spark, monkeypatch):
    """However many blocks hold an item, it leaves the worker once, unless more tokens are held than a worker may."""
    texts = ["a b c a", "b c d", "a b"] * 20
    monkeypatch.setattr(lm, "BLOCK_CHARS", 10)
    rows = counted(texts)
    items = [(r["ord"], h, g) for r in rows for h, g in zip(r["h"], r["g"] or [0] * len(r["h"]), strict=True)]
    assert len(items) == len(set(items)) == 5 + 9
    assert sum(n for r in rows if r["ord"] == 1 for n in r["n"]) == sum(n for r in rows if r["ord"] == 2 for n in r["n"]) == 20 * 12
    assert all(np.uint64(h % 2**64) >> np.uint64(64 - lm.BUCKET_BITS) == r["bucket"] for r in rows for h in r["h"])
    monkeypatch.setattr(lm, "HELD_TOKENS", 10)
    assert len(counted(texts)) > len(rows)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "false AS held_out", "text").repartition(3)
    got = {(r.ord, r.h, r.g): r.n for r in lm.summed_counts(docs).collect()}
    want = collections.Counter()
    for r in rows:
        for h, g, n in zip(r["h"], r["g"] or [0] * len(r["h"]), r["n"], strict=True):
            want[r["ord"], h, g] += n
    assert got == want


def test_counts_of_no_texts():
    assert counted([]) == []


def shuffle_files(spark):
    return sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))


def test_files_of_a_shuffle_go_with_its_step(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, there = spark.conf.get(key, None), shuffle_files(spark)
    one = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count()
    held = lm.released(one, "seven")
    for _ in range(100):
        if shuffle_files(spark) <= there:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= there and held.count() == 7 and spark.conf.get(key, None) == before


def test_open_tokens_are_joined_in_rounds(spark, docs, monkeypatch):
    """A round moves no more rows than the counts have; all rounds together give each text's score."""
    monkeypatch.setattr(lm, "BITS_PER_ITEM", 1_000)
    steps = []
    monkeypatch.setattr(lm, "released", lambda df, name, real=lm.released: steps.append(name) or real(df, name))
    scores = {}
    for rows in (None, 10**9):
        train = lm.train
        with monkeypatch.context() as patch:
            if rows:
                patch.setattr(lm, "train", lambda *a, **k: ((made := train(*a, **k))[0].update(rows=rows), made)[1])
            steps.clear()
            scores[rows] = sorted((str(r.doc_id), round(r.score, 6)) for r in lm.score_documents(docs, max_filter_bits=lm.BLOCKS * 8).collect())
            assert (steps.count("open") > 1) == (rows is None)
    assert scores[None] == scores[10**9]


def test_words_outside_the_filter_are_told_by_the_broadcast_counts(spark, docs):
    """With all words in the head and none in the filter, no token waits for the count of a word."""
    rows = lm.flagged(docs)
    model, _, shared = lm.train(rows.filter("NOT held_out"), max_filter_bits=lm.BLOCKS * 8)
    assert model["cut"][1] > 1 and model["head_level"] == 1
    batches = rows.toArrow().to_batches()
    import types

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
        out = pa.Table.from_batches(list(lm.score_partition(iter(batches), model, types.SimpleNamespace(value=shared)))).to_pylist()
    assert sum(len(r["open"]) for r in out) > 0
    ones = np.arange(1, 5_000)
    assert (lm.level_floor(lm.level_of(ones)) <= ones).all() and (ones <= lm.level_top(lm.level_of(ones))).all()
    known = sum(r["n_known"] for r in out)
    assert sum(len(r["rare"]) for r in out) <= 2 * (sum(r["n_tokens"] for r in out) - known)


def test_filter_is_never_too_low(spark, sf_dir):
    rows = lm.flagged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for bits in (lm.MAX_FILTER_BITS, lm.BLOCKS * 1024):
        model, counts, shared = lm.train(rows.filter("NOT held_out"), max_filter_bits=bits)
        assert len(shared[0]) * 8 <= bits
        held = lm.LogFrequencyFilter(shared[0], model["block_bits"], model["max_level"])
        table = counts.toPandas()
        for order in (1, 2):
            part = table[table.ord == order]
            level = part.level.to_numpy()
            got = held.levels(part.h.to_numpy().view(np.uint64), order)
            inside = level >= model["cut"][order]
            assert (got[inside] >= level[inside]).all() and (got > level).mean() < 0.1


def test_probabilities_sum_to_at_most_one(spark):
    docs = spark.createDataFrame([(i, "a b c a b d a b c") for i in range(40)], "doc_id long, text string")
    model, counts, shared = lm.train(lm.flagged(docs).filter("NOT held_out"))
    held = lm.LogFrequencyFilter(shared[0], model["block_bits"], model["max_level"])
    hasher = WordHasher()
    vocabulary = np.r_[hasher(["a b c d"])[0], lm.END]
    unknown = hasher(["never"])[0]
    for context in vocabulary:
        all_ = np.r_[vocabulary, unknown]
        words = np.unique(all_)
        before = np.full(len(all_), context)
        p = 10 ** lm.bit_probabilities(model, held, all_, before, words, np.searchsorted(words, all_))
        assert 0.5 < p.sum() <= 1.001


def test_levels():
    counts = np.arange(1, 3000)
    level = np.floor(np.log(counts) / np.log(lm.BASE) + 1e-9).astype(int) + 1
    assert (lm.level_floor(level) <= counts).all() and (counts <= lm.level_top(level)).all()


def test_word_hashes_by_text(monkeypatch):
    hasher = WordHasher()
    texts = ["A b\ta", "", "  \n", "b", "é É x\x0by", "a" * 10_000 + " a"]
    hashes, second, counts = hasher(texts)
    assert counts.tolist() == [3, 0, 0, 1, 4, 2]
    assert hashes[0] == hashes[2] == hashes[-1] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == len(set(second.tolist())) == 7
    assert [x.size for x in hasher([])] == [0, 0, 0]
    one_by_one = np.concatenate([hasher([t])[0] for t in texts])
    assert (one_by_one == hashes).all()
    for size in (1, 2, 7):
        monkeypatch.setattr(word_hash, "SLICE", size)
        assert all((a == b).all() for a, b in zip(hasher(texts), (hashes, second, counts), strict=True))


def test_words_that_collide_modulo_a_power_of_two():
    """Thue-Morse words, which any polynomial hash modulo 2**64 takes for one, and permutations of one another."""
    thue = "".join("ab"[n.bit_count() & 1] for n in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    words = [thue, other, thue[:64], other[:64], thue[:63], "abab", "baba", "aabb", "ab" * 400, "ba" * 400]
    h, g, _ = WordHasher()([" ".join(words)])
    assert len(set(h.tolist())) == len(set(g.tolist())) == len(words)


def test_equal_first_halves_are_told_apart():
    h, g = np.array([5, 3, 5, 5, 9], np.uint64), np.array([1, 1, 2, 1, 7], np.uint64)
    first, second, place = word_hash.distinct(h, g)
    assert list(zip(first.tolist(), second.tolist(), strict=True)) == [(3, 1), (5, 1), (5, 2), (9, 7)] and place.tolist() == [1, 0, 2, 1, 3]
    head = (np.array([5, 5, 8], np.uint64), np.array([1, 2, 4], np.uint64), np.array([10, 20, 30]))
    known, n = lm.in_head(first, second, head)
    assert known.tolist() == [False, True, True, False] and n.tolist() == [0, 10, 20, 0]


def test_pieces_of_a_long_text_add_up():
    r = np.random.default_rng(2)
    text = " ".join("".join(chr(97 + x) for x in r.integers(0, 6, r.integers(1, 5))) for _ in range(3_000))
    assert "".join(lm.pieces(text, 500)) == text and max(map(len, lm.pieces(text, 500))) < 520
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([False] * 3), pa.array(["x y", text, "z"])], names=["doc_id", "held_out", "text"])
    whole, cut = ([lm.Tokens()] for _ in range(2))
    seen = []
    for of, chars in ((whole[0], 10**6), (cut[0], 500)):
        rows = [of(b) for b in lm._blocks(iter([batch]), chars)]
        seen.append(sorted(zip(np.concatenate([r[0] for r in rows]).tolist(), np.concatenate([r[2] for r in rows]).tolist(), strict=True)))
        assert sum(r[3].sum() for r in rows) == 3 + 3_001 + 2
    assert seen[0] == seen[1]


def test_scores_do_not_depend_on_pieces(spark, docs, monkeypatch):
    rows = docs.select("doc_id", "text")
    want = lm.score_documents(rows, head_words=20).collect()
    model, counts, shared = lm.train(lm.flagged(rows).filter("NOT held_out"), head_words=20)
    import types

    batches = lm.flagged(rows).coalesce(1).toArrow().to_batches()
    monkeypatch.setattr(lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    for chars in (200, 5_000, 10**7):
        monkeypatch.setattr(lm, "BLOCK_CHARS", chars)
        out = pa.Table.from_batches(list(lm.score_partition(iter(batches), model, types.SimpleNamespace(value=shared)))).to_pylist()
        whole = [r for r in out if r["n_tokens"] is not None]
        assert len(whole) == len(want) and len({r["rid"] for r in whole}) == len(want)
        assert sorted(round(r["score"], 6) for r in whole) == sorted(round(r.score, 6) for r in want)
        assert sorted(r["n_tokens"] for r in whole) == sorted(r.n_tokens for r in want)
        tails = {r["rid"]: 0 for r in whole}
        for r in out:
            tails[r["rid"]] += sum(r["tail_n"])
        assert sorted(tails[r["rid"]] + r["n_known"] for r in whole) == sorted(r.n_tokens for r in want)


def test_empty_table(empty):
    assert lm.score_documents(empty).collect() == []
