import random

import pytest

from millrace.sources.tables import scan_parquet

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def documents(spark):
    return scan_parquet(spark, FOLDER, "documents")


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows and a column of another's name."""
    rng = random.Random(3)
    text = prose(rng, 80)
    rows = [
        (1, text, "en", "a", 1, "x"), (1, text, "en", "a", 1, "x"), (2, text, None, None, None, None),
        (3, None, "en", "a", 0, "x"), (4, "", "de", "b", 0, "x"), (None, text, "en", "a", 1, "x"),
        (5, " \n\t ", "en", "a", 1, "x"), (6, prose(rng, 20_000), "en", "a", 1, "x"), (7, "one", "fr", "c", 1, "x"),
        (None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("extra", "key")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
