from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "documents labels conversations".split()

LONG = "word " * 40_000 + "\n" + "é漢 <|endoftext|> tail 123 " * 3_000
#: Nulls in any column, empty and very long texts, ties, repeated rows, odd white space.
ROWS = [
    (1, "The cat sat on the mat. " * 20, "en", "a", 5), (2, "The cat sat on the mat. " * 20, "en", "b", 5),
    (2, "The cat sat on the mat. " * 20, "en", "b", 5), (3, None, None, None, None), (None, "lonely", "en", "a", 1),
    (None, "lonely", "en", "a", 1), (4, "", "en", "a", 0), (5, " \n\t ", None, "a", 3), (6, LONG, "fr", "hot", 9),
    (7, "A\x1cb c　d é ſ 😀 <|startoftext|>x's", "de", "hot", 9), (7, "another text of the same number", "de", None, 9),
    (8, "the cat sat on the mat. " * 20, "en", "hot", 5), (-9, "minus", "en", "hot", 5), (10, None, "en", "hot", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    """The rows with columns whose names the operators use themselves."""
    names = "_row _run _digest _keep _doc _id _text _y _n _key fp block part size word n label chance key".split()
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("own").alias(n) for n in names]).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
