"""The pipeline's stages on the fixture, and as a whole."""

import corpus_pipeline as pipeline
from tests.llm.test_tokens import check_packing
from tidegauge.llm import packing
from tidegauge.llm.pretokens import vocabulary_path


def test_stages(spark, mini, docs):
    from tokenizers import Tokenizer

    df, seen = spark.read.parquet(f"{mini}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before, df = df, stage(spark, df, mini)
        seen[name] = (before, df)
        if name != "packing":
            assert df.columns == docs.columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, (_, d) in seen.items() if n != "packing"}
    assert {1, 2, 3, 4, 5, 40} <= set(ids["quality"])
    assert 1 in ids["near_dedup"] and not {2, 3} & set(ids["near_dedup"])
    masked = {r.doc_id: r.text for r in seen["pii"][1].collect()}
    if 15 in masked:
        assert "@" not in masked[15] and "4111" not in masked[15]
    kept = [(r.doc_id, r.text) for r in seen["packing"][0].select("doc_id", "text").collect()]
    check_packing(seen["packing"][1].collect(), kept, Tokenizer.from_file(vocabulary_path(packing.VOCABULARY)))


def test_run(spark, mini):
    rows = pipeline.run(spark, mini)
    assert rows.columns == [x.split()[0] for x in packing.SCHEMA.split(", ")] and rows.count() > 0


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))


def test_columns_of_any_name(spark, mini):
    """Extra columns with an underscore in front, a dot, a dash, a backtick or capitals go through every stage but the last."""
    from pyspark.sql import functions as F

    names = ["_id", "_tk", "_key", "a.b", "n-chars", "Mixed Case", "tk", "sid", "masked", "x`y", "log_weight", "none"]
    df = spark.read.parquet(f"{mini}/documents.parquet").withColumns({n: F.lit(n) for n in names})
    columns = df.columns
    for name, stage in pipeline.STAGES:
        df = stage(spark, df, mini)
        if name != "packing":
            row = df.first()
            assert df.columns == columns and all(row[columns.index(n)] == n for n in names), name
    assert df.count() > 0


def test_queries_on_columns_of_any_name(spark, mini, tmp_path):
    """Every opN over documents takes a table with such columns."""
    from pyspark.sql import functions as F

    from tidegauge.llm import registry

    names = ["_id", "_tk", "_key", "a.b", "n-chars", "Mixed Case", "tk", "sid", "h0", "x`y", "words", "at"]
    spark.read.parquet(f"{mini}/documents.parquet").withColumns({n: F.lit(n) for n in names}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{mini}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name, query in registry.QUERIES.items():
        if int(name[2:].split("_")[0]) not in (3, 5, 13):
            assert query(spark, str(tmp_path)).count() >= 1, name
