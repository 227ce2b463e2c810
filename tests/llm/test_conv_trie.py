"""Operator 13 against a trie of dictionaries."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import conv_trie

COLUMNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = sha256((f"{len((role or '').encode())}:" + (role or "") + (text or "")).encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(found)] for c, found in own.items()}
    out = {}
    for c, found in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(turns.get(c - int(abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + found[h:])
    return out


def plain(sequences):
    """The nodes of {id: tuple of (role, text)}."""
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    words = lambda t: len([w for w in t.translate({c: " " for c in range(9, 14)}).split(" ") if w])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (words(node[-1][1]) if node else 0)
    ends = lambda node: ",".join(map(str, sorted(c for c in members[node] if sequences[c] == node)))
    return sorted(
        [(min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), leaves[n], saved[n], sha256(ends(n).encode()).hexdigest()) for n in members],
        key=str)


def made(seed, convs=120):
    r = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = r.choice([None, -3, 0, 20, *range(60), *range(60)])
        rows += [(c, r.choice([None, *range(6)]), r.choice([None, "user", ""]), r.choice([None, "", "a b", "a\tb c", "long  words here"])) for _ in range(r.randint(1, 3))]
    return rows


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("seed", "block", "fan"), [(1, 1, 2), (2, 3, 2), (3, 7, 3), (4, 250_000, 256)])
def test_against_dictionaries(spark, seed, block, fan):
    rows = made(seed)
    df = spark.createDataFrame(rows, COLUMNS)
    assert got(conv_trie.prefix_trie(df, block, fan)) == plain(rebuilt(rows))


def sweep(sequences, cuts, fan):
    """The sweeps without Spark: nodes whose parents were found, as in ``trie_of``."""
    key = lambda s: b"".join(sha256(repr(t).encode()).digest()[:16] for t in s)
    order = sorted((key(s), c, [len(t[1].split()) for t in s]) for c, s in sequences.items())
    bounds = [0, *cuts, len(order)]
    parts = [list(enumerate(order))[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]
    steps, runs = [[]], defaultdict(list)
    for n, part in enumerate(parts):
        block = conv_trie.Block(parts[n - 1][-1][1][0] if n else None)
        for x, (k, c, words) in part:
            block.add(x, c, k, words)
        block.end(*((parts[n + 1][0][0], parts[n + 1][0][1][0]) if n + 1 < len(parts) else (None, None)))
        steps[0].append(block.sweep)
        for name, c in block.runs:
            runs[name].append(c)
    while True:
        groups, last = [steps[-1][i : i + fan] for i in range(0, len(steps[-1]), fan)], len(steps[-1]) <= fan
        steps.append([])
        for group in groups:
            one = conv_trie.Sweep()
            for x, level, cum, k, ends, digest, inside, cell in [i for s in group for i in s.items]:
                one.boundary(conv_trie.Group(x, level, cum, k, ends, digest, None, inside, [], [x]))
                one.tail = cell
            one.finish() if last else one.stop()
            steps[-1].append(one)
        if last:
            break
    nodes, known = [], {}
    for step in reversed(steps):
        nodes += [n for s in step for n in s.nodes] + [(*w[1:3], known[w[0]], *w[3:]) for s in step for w in s.waiting]
        known = {x: c for s in step for x, c in s.named} | {x: known[y] for s in step for x, y in s.merged if y in known}
    digest = lambda e: sha256(",".join(map(str, sorted(runs[e]))).encode()).hexdigest() if e.startswith("run:") else e
    return sorted([(*n[:7], digest(n[7])) for n in nodes], key=str)


def test_sweeps_of_any_blocks():
    """Copies, prefixes, empty sequences and long chains, cut anywhere."""
    for seed in range(300):
        r = random.Random(seed)
        pool = [("u", t) for t in ("a", "b c", "", "d e f")[: r.randint(1, 4)]]
        sequences = {}
        for c in r.sample(range(-50, 400), r.randint(1, 40)):
            start = r.choice(list(sequences.values())) if sequences and r.random() < 0.5 else ()
            start = start[: r.randint(0, len(start))] if r.random() < 0.6 else start
            sequences[c] = start + tuple(r.choice(pool) for _ in range(r.choice([0, 0, 1, 2, 9])))
        n = len(sequences)
        cuts = sorted(r.sample(range(1, n), r.randint(0, min(n - 1, 12)))) if n > 1 else []
        assert sweep(sequences, cuts, r.choice([2, 3, 50])) == plain(sequences), seed


def test_a_third_of_all_rows_in_one_group_of_copies(spark):
    rows = [(20 * (c + 1) if c < 400 else 20 * (c + 1), t, "user", "same" if c < 400 else f"t{c}") for c in range(1_000) for t in range(2)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert got(conv_trie.prefix_trie(df, 50, 4)) == plain(rebuilt(rows))


def test_one_long_conversation(spark):
    rows = [(5, t, "user", f"w{t % 7} x") for t in range(3_000)] + [(c, t, "user", f"w{t % 7} x") for c in (6, 25) for t in range(2_900)]
    found = got(conv_trie.prefix_trie(spark.createDataFrame(rows, COLUMNS), 1, 2))
    assert found == plain(rebuilt(rows)) and len(found) > 2_900


def test_empty_table_and_clashing_columns(spark):
    assert conv_trie.prefix_trie(spark.createDataFrame([], COLUMNS)).collect() == []
    rows = made(9, 30)
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(1) for c in ("t", "key", "words", "h", "family", "x", "part", "step", "_id", "a.b", "n-chars", "Turns")})
    assert got(conv_trie.prefix_trie(df)) == plain(rebuilt(rows))


def test_sql_on_the_fixture(spark, tmp_path):
    rows = made(11)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/conversations")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations/*.parquet'")
    assert sorted(con.execute(conv_trie.SQL).fetchall(), key=str) == plain(rebuilt(rows))
