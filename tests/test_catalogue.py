"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(names):
    return sorted(n for n in names if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", plain(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    a = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    b = sorted(tuple(norm(r[found.columns.index(c)]) for c in columns) for r in found.fetchall())
    assert a == b


@pytest.mark.parametrize("name", plain(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
