"""Near-duplicates of the pipeline against brute force over all pairs."""

import random

import numpy as np
import pytest

from tidegauge.llm import near_dedup
from tidegauge.llm.simhash import Fingerprints


def words(r: random.Random, n: int) -> list[str]:
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def changed(r: random.Random, base: list[str], times: int) -> list[str]:
    out = list(base)
    for at in r.sample(range(len(out)), times):
        out[at] = f"x{r.randrange(10**9)}"
    return out


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def resemblance(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def groups(rows: list[tuple]) -> list[int]:
    """The least place of each row's group, by comparing all pairs."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if up[i] != up[j] and resemblance(sets[i], sets[j]) >= 0.8:
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    return up


@pytest.mark.parametrize("hot_shard", [4, near_dedup.HOT_SHARD])
def test_brute_force(spark, hot_shard):
    """A large family, whose shards are hot when hot_shard is low, and isolated pairs."""
    r = random.Random(3)
    base, rows = words(r, 120), []
    for _ in range(60):
        rows.append(" ".join(changed(r, base, r.choice((1, 1, 2, 3)))))
    for _ in range(30):
        one = words(r, 150)
        rows += [" ".join(one), " ".join(changed(r, one, r.choice((1, 2, 3, 6))))]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {x.doc_id for x in near_dedup.keep_one_of_each(df, hot_shard=hot_shard).collect()}
    assert kept == set(groups(rows))


def test_search_is_exact():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 60, 80, dtype=np.uint64)
    sets = [np.unique(np.r_[r.choice(base, 76, replace=False), r.integers(0, 1 << 60, 4, dtype=np.uint64)]) for _ in range(40)]
    up = list(range(40))
    of = Fingerprints(5, near_dedup.PRINT_WORDS)
    for i, j in near_dedup.resembling([near_dedup.set_print(of, s) for s in sets], sets):
        assert len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
        up = [up[i] if u == up[j] else u for u in up]
    for i in range(40):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                assert up[i] == up[j]


@pytest.mark.parametrize(("shared", "floor"), [(160, 0.99), (165, 0.995), (170, 0.995)])
def test_recall_of_isolated_pairs(shared, floor):
    """Pairs of resemblance shared / 200: no other member of a group helps them."""
    r, found, n = np.random.default_rng(shared), 0, 1_000
    for _ in range(n):
        h = r.integers(0, 1 << 63, 200, dtype=np.uint64)
        half = shared + (200 - shared) // 2
        least = np.stack([near_dedup.least_hashes(h[:half]), near_dedup.least_hashes(np.r_[h[:shared], h[half:]])])
        keys = near_dedup.band_keys(least)
        found += bool((keys[0] == keys[1]).any())
    assert found / n >= floor


def test_rows_not_ids(spark):
    """One id with two texts: the one near to another document goes, the unrelated one stays."""
    r = random.Random(7)
    a, b, c = words(r, 100), words(r, 100), words(r, 100)
    rows = [(1, " ".join(a)), (2, " ".join(changed(r, a, 1))), (2, " ".join(b)), (3, " ".join(c)), (3, " ".join(c)), (None, " ".join(a)), (4, ""), (5, None), (5, " ".join(b))]
    got = near_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x.doc_id or 0, x.text) for x in got)) == sorted([(0, rows[5][1]), (1, rows[0][1]), (2, rows[2][1]), (3, rows[3][1]), (4, "")])


def test_set_of_short_texts():
    of = Fingerprints(5)
    assert len(near_dedup.shingle_set(of, "")) == 0 and len(near_dedup.shingle_set(of, "one two")) == 1


@pytest.mark.parametrize(("shared", "extra"), [(4, 1), (8, 2), (12, 3), (160, 40), (800, 200)])
def test_radius_reaches_resemblance(shared, extra):
    """Sets of resemblance 0.8, one holding the other, lie within the radius."""
    r, of, far, n = np.random.default_rng(shared), Fingerprints(5, near_dedup.PRINT_WORDS), 0, 300
    for _ in range(n):
        h = r.integers(0, 1 << 63, shared + extra, dtype=np.uint64)
        a, b = (int.from_bytes(near_dedup.set_print(of, x), "little") for x in (h[:shared], h))
        far += (a ^ b).bit_count() > near_dedup.RADIUS
    assert far <= 1


def test_keep_one_of_each(spark, docs, empty):
    out = near_dedup.keep_one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and ids.count(12) == 1 and {4, 5, 13, 15, 20, 21, 40} <= set(ids)
    assert ids.count(None) == 2 and [i for i in ids if i in (6, 7, 8)] == [6]
    assert near_dedup.keep_one_of_each(empty).collect() == []
