"""Operator 5 against brute force."""

import numpy as np
import pytest

from tidegauge.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string, list int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            best = {}
            for i, x in good:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(v @ x))
            out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    return hit / max(1, sum(map(len, want.values())))


def test_recall_and_scores(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got, want = result(ann.search(table)), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 20
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))


def test_lengths_of_vectors_differ(spark):
    """Inner product, not cosine: long vectors win."""
    r = np.random.default_rng(1)
    rows = [(i, (r.standard_normal(8) * (10 if i % 7 == 0 else 1)).astype(np.float32).tolist()) for i in range(400)]
    assert recall(result(ann.search(frame(spark, rows))), brute(rows)) >= 0.9


def test_unusable_vectors_ties_and_repeats(spark):
    v = [1.0, 0.0, 0.0, 0.5]
    rows = [(i, v) for i in range(60)] + [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]), (None, v), (106, [1.0, 2.0]), (3, v), (20, v)]
    got = result(ann.search(frame(spark, rows)))
    assert got.keys() == {0, 20, 40}
    # All are equally near, so the smaller ids win as far as lists were probed.
    assert all(len(f) == 20 and [i for i, _ in f] == sorted(i for i, _ in f) and q not in {i for i, _ in f} for q, f in got.items())


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_rows(spark, n):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(n)]
    got = result(ann.search(frame(spark, rows)))
    want = brute(rows)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items() if f}


def test_scan_keeps_what_is_within_the_bound():
    r = np.random.default_rng(3)
    q, x = r.standard_normal((20, 64)), r.standard_normal((500, 64))
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    bound = np.sort(d, axis=1)[:, 19]
    who, at = ann.scan(q, bound, x)
    assert (d[who, at] <= bound[who] + 1e-6).all() and len(who) > 0.95 * 20 * 20


def test_recall_where_lists_matter(spark, sf_dir):
    """Far more rows than anchors: without structure, and the table of the next size."""
    r = np.random.default_rng(11)
    x = r.standard_normal((12_000, 32)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    for df in (rows, table):
        held = sorted(((v.vec_id, v.embedding) for v in df.collect()), key=lambda p: p[0])
        ids, vectors = np.array([i for i, _ in held]), np.array([v for _, v in held], float)
        got, hit, n = result(ann.search(df)), 0, 0
        for q in ids[ids % 20 == 0]:
            s = vectors @ vectors[np.searchsorted(ids, q)]
            s[ids == q] = -np.inf
            hit += len({i for i, _ in got[int(q)]} & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
            n += 20
        assert hit / n >= 0.9


def test_query_id_with_two_vectors(spark):
    """The least of its vectors asks; none of its own rows answers."""
    rows = [(i, [float(i), 1.0]) for i in range(1, 20)] + [(20, [2.0, 0.0]), (20, [-2.0, 0.0])]
    got = result(ann.search(frame(spark, rows)))
    assert [i for i, _ in got[20]] == list(range(1, 20)) and got[20][0][1] == -2.0
