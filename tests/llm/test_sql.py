"""Operators with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from cladeforge.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = c.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == columns
    a = sorted(tuple(norm(r[x]) for x in columns) for r in df.collect())
    assert a == sorted(tuple(norm(r[found.columns.index(x)]) for x in columns) for r in found.fetchall())
