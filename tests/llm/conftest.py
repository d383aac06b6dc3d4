import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """doc_id -> text."""
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one"),
    (None, "one two three four five six"),
    (7, "one two three four five six"),
    (7, "one two three four five six"),
    (8, "Größe   naïve \U0001f600 text\rwith\x0bodd\x0cspaces 1 2 3"),
    (9, "word " * 30_000),
    (10, "x" * 300_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated keys and texts, very long texts, extra columns with clashing names."""
    rows = [(i, t, "a", 1, "n", 2) for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, key string, n int, node string, rid int"
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
