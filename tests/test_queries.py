"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from docloom.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark_df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(theirs.columns)
    order = sorted(spark_df.columns)

    def plain(x):
        if isinstance(x, float):
            return round(x, 8)
        return tuple(map(plain, x)) if isinstance(x, list | tuple) else x

    ours = sorted(repr(tuple(plain(r[c]) for c in order)) for r in spark_df.collect())
    at = {c: i for i, c in enumerate(theirs.columns)}
    expected = sorted(repr(tuple(plain(r[at[c]]) for c in order)) for r in theirs.fetchall())
    assert ours == expected


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
