"""Every query with SQL against DuckDB on the smallest tables, and the driver contract."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from cadenza.plans import catalog, pieces  # noqa: F401: pieces adds its queries to the catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ENTRIES))
def test_query(spark, con, name):
    f, sql = catalog.ENTRIES[name]
    got = f(spark, DATA)
    if sql is None:
        assert got.count() > 0
        return
    said = con.execute(sql)
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(map(plain, r)) for r in got.select(*columns).collect()) == Counter(tuple(map(plain, r)) for r in said.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_prune_and_push_down(spark):
    """Scans read the columns that a query needs, filters reach them, and no plan has a product of tables."""
    text = catalog.q14_semi(spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,49.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    for name in ("q09_asof_backward", "q10_nearest", "q12_interval_overlap"):
        plan = catalog.ENTRIES[name][0](spark, DATA)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
