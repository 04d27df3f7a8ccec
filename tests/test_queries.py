"""Every query against its SQL in DuckDB, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from ledgerloom import queries as q

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SMALL)
    want = duck.sql(q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SMALL).count() > 0


def test_profile_reads_a_table_once(spark):
    from ledgerloom.operators.profile import column_stats

    plan = column_stats(spark.read.parquet(f"{SMALL}/customer.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_incremental_filter_reaches_the_scan(spark):
    df = q.QUERIES["scan_incremental"](spark, SMALL)
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in df._jdf.queryExecution().executedPlan().toString()
