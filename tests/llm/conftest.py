import random

import pytest

WORDS = "the of and to in is was for that with from have this will your which their said each about how many then them these some would other into more".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(60)]
    return " ".join(r.choice(WORDS + made) for _ in range(n)).capitalize() + "."


#: Columns whose names the operators use themselves.
CLASHES = {"score": 1.0, "row": "x", "fingerprint": "y", "component_id": 7, "kept": "no", "next": 0, "f0": 5, "u": 1, "rank": 2, "good": "z"}


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empties, ties, repeated rows, copies, near copies, a very long text, text of many scripts."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    junk = " ".join(w.upper() + "!!" for w in prose(2, 60).split())
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(3, 80)), (5, prose(4, 40)), (6, None), (7, ""), (8, "   \n\t "), (None, prose(5, 30)), (None, None), (9, "one"), (10, "two words"),
        (11, "日本語のテキスト 123 ١٢٣ é́ 😀 don't  I'll\r\n x"), (12, prose(6, 30_000)), (12, prose(6, 30_000)), (13, junk), (14, junk + " x!!"), (15, "call (743) 555-3824 or mail ann@example.com, card 4111 1111 1111 1111 at 10.0.0.1"),
        (20, "a" * 3000), (21, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'), (40, prose(7, 200)),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    good = [(i, 1, 0) for i in (1, 2, 3, 4, 5, 40)]
    return spark.createDataFrame([*good, (13, 0, 0), (14, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def mini(spark, docs, labels, tmp_path_factory):
    """A folder of tables made of the fixture."""
    root = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    return str(root)
