"""Operator 7: candidates against a plain pattern, the forest on unseen findings."""

import re

from pyspark.sql import functions as F

from tidegauge.llm import secrets

PLAIN = re.compile(r"(?<![A-Za-z0-9+/_=\-])(?=[A-Za-z+/_=\-]*+[0-9])[A-Za-z0-9+/_=\-]{16,}+")


def test_candidates(spark, docs, texts):
    rows = secrets.candidates(docs).collect()
    want = sorted((i, m.start(), m.end(), m.group()) for i, t in texts if i is not None for m in PLAIN.finditer(t or ""))
    assert sorted((r.doc_id, r.start, r.end, r.candidate) for r in rows if r.doc_id is not None) == want


def test_many_candidates_in_one_text(spark):
    text = "é " + " ".join(f"key{n:04d}abcdefghijk" for n in range(700))
    rows = secrets.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 700 and all(text[r.start : r.end] == r.candidate for r in rows)
    assert all(r.before == text[max(0, r.start - 1) : r.start] or r.before.endswith(" ") for r in rows)


def test_unseen_findings(spark):
    forest = secrets.train(secrets.labelled(spark, secrets.generated_findings()))
    unseen = secrets.labelled(spark, secrets.generated_findings(1_000, seed=4242))
    unseen = unseen.withColumn("f", F.struct(*secrets.features(F.col("before"), F.col("candidate"), F.col("after"))))
    rows = unseen.select("secret", secrets.forest_column(forest, F.col("f")).alias("p")).collect()
    right = sum((r.p >= 0.5) == r.secret for r in rows)
    assert right / len(rows) > 0.95


def test_query_finds_the_token(spark, mini):
    rows = secrets.op7_secret_forest(spark, mini).collect()
    assert [(r.doc_id, r.candidate) for r in rows if r.is_secret] == [(21, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]


def test_native_plan(spark, mini, capsys):
    secrets.op7_secret_forest(spark, mini).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_empty_table(empty):
    assert secrets.scan(empty, forest=[0.5]).collect() == []
