"""Every registered query against its SQL counterpart on the smallest tables."""

import importlib.util
import math
import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
spec = importlib.util.spec_from_file_location("spark_entry", f"{ROOT}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert table(df.columns, rows) == table(rel.columns, rel.fetchall())


def test_every_counterpart_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert {r["split"] for r in entry.entry(spark).collect()} == {"selection_holdout", "calib", "test"}
