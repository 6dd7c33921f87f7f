"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from strandlake import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    shown = frame[cols].apply(lambda c: c.map(lambda v: repr(float(v)) if isinstance(v, float) else str(v)))
    return cols, shown.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, small, name):
    got = rows(queries.QUERIES[name](spark, small).toPandas())
    want = rows(duck.execute(queries.ORACLE_SQL[name]).fetchdf())
    assert got[0] == want[0]
    assert got[1].equals(want[1])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    assert queries.entry(spark, small).count() == 64
