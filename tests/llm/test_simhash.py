"""Operator 6 against brute force."""

import random
import re

import pytest
import xxhash

from tidegauge.llm import simhash


def fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum((2 * c > len(shingles)) << b for b, c in enumerate(counts))


def components(prints, radius=3):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows}
    want = components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_edge_rows(spark, docs, texts):
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == len(texts)
    prints = {i: fingerprint(t) for i, t in texts if i is not None}
    want = components(prints)
    for r in rows:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    nulls = sorted(r.fingerprint for r in rows if r.doc_id is None)
    assert nulls == sorted(f"{fingerprint(t):016x}" for i, t in texts if i is None)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {min(i for i, p in prints.items() if p == 0)}


@pytest.mark.parametrize("block", [4, simhash.BLOCK])
def test_hot_shards_lose_no_link(spark, block):
    """A chain and a cloud of fingerprints that crowd into the same bands."""
    r = random.Random(4)
    base, prints = r.getrandbits(64), {}
    for i in range(300):
        value = base
        for _ in range(r.randint(0, 5)):
            value ^= 1 << r.randrange(64)
        prints[i] = value
    for i in range(300, 330):
        prints[i] = r.getrandbits(64)
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in prints.items()]
    df = spark.createDataFrame(signed, "doc_id long, f0 long").repartition(4)
    bands, again = simhash.disjoint_bands(3)
    found = simhash.cluster(df, ["f0"], lambda d: simhash.link_fingerprints(d, ["f0"], bands, 3, again, hot_shard=8, block=block))
    assert {x.doc_id: x.component_id for x in found.collect()} == components(prints)


def test_tree_and_pairs_agree():
    r = random.Random(5)
    values = list({(r.getrandbits(64) & ~0xFFFF) | r.getrandbits(8) for _ in range(40)} | {0x12345 ^ 1 << r.randrange(20) ^ 1 << r.randrange(20) for _ in range(60)})
    forest = simhash.Forest(len(values))
    for a, b in simhash.shard_links(values, 3):
        assert (values[a] ^ values[b]).bit_count() <= 3
        forest.join(a, b)
    want = components(dict(enumerate(values)))
    assert all((forest.root(i) == forest.root(j)) == (want[i] == want[j]) for i in range(len(values)) for j in range(i))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (201, 200), (5, 5)], "u long, v long")
    got = {r.fid: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 71)}, 201: 200}


def test_empty_table(empty):
    assert simhash.simhash_components(empty).collect() == []


def test_every_shard_is_searched_by_its_tree(monkeypatch):
    """Each member of a shard of any size is one search of the shard's tree, and nothing else compares fingerprints."""
    searched = []
    add = simhash.BkTree.add_and_search
    monkeypatch.setattr(simhash.BkTree, "add_and_search", lambda tree, value, radius: searched.append(value) or add(tree, value, radius))
    for size in (2, 3, 40):
        searched.clear()
        list(simhash.shard_links(list(range(size)), 3))
        assert searched == list(range(size))


def test_tree_follows_only_edges_within_the_radius():
    r = random.Random(9)
    tree, values = simhash.BkTree(), [r.getrandbits(64) for _ in range(400)]
    for n, v in enumerate(values):
        assert sorted(tree.add_and_search(v, 3)) == [i for i in range(n) if (values[i] ^ v).bit_count() <= 3]
    for node, kids in enumerate(tree.children):
        assert all((tree.values[node] ^ tree.values[k]).bit_count() == d for d, k in kids.items())
