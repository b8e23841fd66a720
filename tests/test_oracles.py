"""Every registered query with an SQL equivalent, against DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = os.environ.get("ORACLE_NAMES", "").split() or sorted(entry_point.oracle_sql())


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    out = entry_point.queries()[name](spark, DIR)
    rows = out.collect()
    rel = db.sql(entry_point.oracle_sql()[name])
    assert sorted(out.columns) == sorted(rel.columns)
    order = sorted(out.columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    at = [rel.columns.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert len(mine) == len(want)
    assert mine == want


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10
