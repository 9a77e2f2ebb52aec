"""Every registered query with SQL must return what DuckDB returns for that SQL."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_queries import compare

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="star-schema tables not present")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    outcome = compare(spark, SMALL, name)
    assert outcome.startswith("OK"), outcome


def test_registry_covers_the_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert {"request_id", "model", "rank", "track_id"} <= set(df.columns)
    assert {r.model for r in df.select("model").distinct().collect()} == {"knn", "cosine", "collaborative"}
