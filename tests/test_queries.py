"""Every registered query: equal to its SQL, or at least a non-empty table."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check_queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(check_queries.QUERIES))
def test_query(spark, con, name):
    verdict = check_queries.compare(spark, con, name, FOLDER)
    assert not verdict.startswith("FAIL"), verdict
    assert "TYPES" not in verdict, verdict
    if verdict.startswith("rows only"):
        assert verdict != "rows only: 0"
