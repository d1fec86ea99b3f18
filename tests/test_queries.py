"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from lodestone.plans import flagship, oracle_sql, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in oracle_sql():
        assert got
        return
    rel = duck.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_flagship(spark):
    assert flagship(spark, DIR).columns == ["nation", "change", "pct", "cagr", "trend"]


def test_no_cartesian_products_but_with_one_row(spark):
    for name in ("flagship_trends", "points_in_polygons", "nearest", "interval_overlaps", "as_of_join"):
        plan = queries()[name](spark, DIR)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan, name
