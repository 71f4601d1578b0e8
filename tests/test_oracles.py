"""Each registered query against DuckDB on the same tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from cirrolite.plans.queries import ORACLES, QUERIES

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    c = duck.execute(ORACLES[name])
    columns = [x[0] for x in c.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, c.fetchall())


def test_registry(spark):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and set(QUERIES) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0


def test_first_files_that_share_a_path(spark, tmp_path):
    """More files share the first path than are asked for: however the table is laid out, those of the smallest keys come, in that order; its SQL gives them where the table is in key order."""
    t = spark.range(40).selectExpr("id * 168 AS s_suppkey", "'x' AS s_name", "0 AS s_nationkey", "CAST(id AS DOUBLE) AS s_acctbal")
    spark.read.parquet(f"{DATA}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    t.coalesce(1).write.parquet(f"{tmp_path}/ordered")
    want = [("2024/01/01/K000/K00020240101_000000_V06", 100 * i) for i in range(25)]
    c = duckdb.connect()
    c.execute("set threads = 1")
    c.execute(f"create view supplier as select * from read_parquet('{tmp_path}/ordered/*.parquet')")
    c.execute(f"create view nation as select * from read_parquet('{DATA}/nation.parquet')")
    assert sorted(c.execute(ORACLES["so2_first_files"]).fetchall()) == want
    for layout in (t.orderBy("s_suppkey").coalesce(1), t.orderBy(t.s_suppkey.desc()).coalesce(1), t.repartition(5, "s_suppkey")):
        layout.write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
        assert [tuple(r) for r in QUERIES["so2_first_files"](spark, str(tmp_path)).collect()] == want
