"""Every query with SQL gives what DuckDB gives on the small tables, where these are there."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fuseline.plans import queries as engine

TABLES = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@have
@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query_matches_its_sql(spark, name):
    out = entry.queries()[name](spark, TABLES)
    columns = sorted(out.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in out.collect()), key=str)
    assert got
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for t in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS FROM '{TABLES}/{t}'")
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
    assert got == want


@have
def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@have
def test_plans_read_only_the_columns_they_need(spark):
    plan = entry.queries()["byte_pair_counts"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "CartesianProduct" not in plan
