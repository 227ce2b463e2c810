"""Operator 11 against plain hashing of the whole table."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h("".join(low[i : i + 3])) for i in range(0, len(low), 3)])
    return levels


def path(levels, i):
    out = []
    for low in levels[:-1]:
        at = i - i % 3
        out.append(("".join(low[at:i]), "".join(low[i + 1 : at + 3])))
        i //= 3
    return out


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        own = leaf(r, r["text"])
        shown = own
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
            shown = leaf(r, r["text"].replace("\n", ""))
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, own, shown, r["doc_id"]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s]), tree([x[2] for x in sorted(by[s])])) for s in order}
    over = tree([trees[s][1][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        found, levels = trees[s]
        for i, (_, _, own, shown, doc_id) in enumerate(found):
            steps = path(levels, i) + path(over, n)
            fold = shown
            for left, right in steps:
                fold = h(left + fold + right)
            out.append((doc_id, own, levels[-1][0], over[-1][0], h("".join(a + b for a, b in steps)), fold, fold == over[-1][0]))
    return out


def made(n, seed=0, sources=5):
    r = random.Random(seed)
    return [{"doc_id": r.choice([None, *range(n)]) if i % 50 == 0 else i, "source": r.choice([None, "", "é", "z", *"abcd"[:sources]]) if i % 3 else "hot", "lang": r.choice([None, "en"]), "n_chars": r.choice([None, i]), "text": r.choice([None, "", "a\nb", "x" * (i % 90), "é\n\n"])} for i in range(n)]


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 700])
def test_small_tables(spark, n):
    rows = made(n, n)
    assert got(merkle.manifest(frame(spark, rows), merkle.tampered_text())) == sorted(plain(rows), key=str)


def test_several_supersteps(spark, monkeypatch):
    """A hot source of over SPAN leaves, so that vertices pass messages; repeated rows; other partitions."""
    rows = made(2_600, 7)
    rows += rows[:40] + [rows[3]] * 60
    want = sorted(plain(rows), key=str)
    assert got(merkle.manifest(frame(spark, rows).repartition(5), merkle.tampered_text())) == want
    assert sum(not r[-1] for r in want) > 100


def test_many_sources(spark):
    """More sources than one vertex holds."""
    rows = [{"doc_id": i, "source": f"s{i % 800}", "lang": "en", "n_chars": i, "text": f"t\n{i}"} for i in range(1_700)]
    assert got(merkle.manifest(frame(spark, rows), merkle.tampered_text())) == sorted(plain(rows), key=str)


def test_untouched_rows_all_verify_and_other_columns_do_not_matter(spark, docs, empty):
    named = docs.withColumns({c: F.lit(1) for c in ("src", "leaf", "shown", "at", "place", "total", "part", "_id", "a.b", "Leaf2")})
    rows = merkle.manifest(named).collect()
    assert len(rows) == docs.count() and all(r.verified and r.folded_root == r.root for r in rows)
    assert merkle.manifest(empty).collect() == []


def test_sql_on_the_fixture(spark, tmp_path):
    rows = made(120, 3)
    frame(spark, rows).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, source, lang, n_chars::BIGINT AS n_chars, text FROM '{tmp_path}/documents.parquet'")
    assert sorted(con.execute(merkle.SQL).fetchall(), key=str) == sorted(plain(rows), key=str)
