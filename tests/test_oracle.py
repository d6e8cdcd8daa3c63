"""Every query with SQL against DuckDB on the smallest harness tables."""

import duckdb
import pytest

from scriptoria import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    plain = df[cols].astype(object).where(df[cols].notna(), None)
    plain = plain.map(lambda x: round(float(x), 9) if isinstance(x, float) else x)
    return cols, plain.astype(str).sort_values(cols).values.tolist()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, db, name):
    got = rows(registry.queries()[name](spark, sf_dir).toPandas())
    want = rows(db.sql(registry.oracle_sql()[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).columns
