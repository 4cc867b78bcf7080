"""What differed or grew on larger tables: numbers between two roundings, rows that were shuffled before they were cut."""

import duckdb
import pytest
from pyspark.sql import functions as F

from larder.functions import rules
from larder.plans import catalogue
from tests.helpers import assert_same


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """81 products of one category of which 58 have 23 g of protein in 80 kcal and rank 24: both are 28.75 %, in doubles less."""
    folder = tmp_path_factory.mktemp("halves")
    tables = {
        "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey",
        "supplier": "SELECT 0::BIGINT AS s_suppkey, 'S' AS s_name, 0 AS s_nationkey, 0.0::DOUBLE AS s_acctbal",
        "part": "SELECT i AS p_partkey, 'hot bolt' AS p_name, 'Brand#1' AS p_brand, 'LARGE' AS p_type, (CASE WHEN i < 23 THEN 10 ELSE 23 END)::INTEGER AS p_size, 9.0::DOUBLE AS p_retailprice FROM range(81) t(i)",
        "lineitem": "SELECT i AS l_orderkey, i AS l_partkey, 0::BIGINT AS l_suppkey, 1 AS l_linenumber, 2.0::DOUBLE AS l_quantity, 8000.0::DOUBLE AS l_extendedprice, 0.01::DOUBLE AS l_discount, "
        "0.02::DOUBLE AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1996-09-13' AS l_shipdate FROM range(81) t(i)",
    }
    for name, sql in tables.items():
        duckdb.connect().execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["fact_star", "silver_products", "silver_view"])
def test_halves_are_rounded_up(spark, halves, name):
    assert_same(catalogue.QUERIES[name](spark, halves), catalogue.ORACLES[name], halves)


def test_rounding_of_any_number(spark):
    rows = [(28.749999999999996, 28.8), (28.74, 28.7), (-28.749999999999996, -28.8), (1e300, 1e300), (float("inf"), float("inf")), (None, None)]
    got = spark.createDataFrame(rows, "x double, want double").select(rules.rounded(F.col("x"), 1).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


@pytest.fixture(scope="module")
def gaps(halves, tmp_path_factory):
    """Parts whose newest line has no supplier, no date or a key of more than eight digits, which share a barcode; lines without part."""
    folder = tmp_path_factory.mktemp("gaps")
    line = "SELECT k AS l_orderkey, k AS l_partkey, s AS l_suppkey, (1 + d % 3)::INTEGER AS l_linenumber, (d * 3)::DOUBLE AS l_quantity, (1000 * d + 5)::DOUBLE AS l_extendedprice, 0.01::DOUBLE AS l_discount, 0.02::DOUBLE AS l_tax, 'A' AS l_returnflag, 'O' AS l_linestatus"
    lines = f"""{line}, CASE WHEN d < 9 THEN TIMESTAMP '1996-09-13' + to_days((d // 2)::INTEGER) END AS l_shipdate
    FROM (SELECT unnest([1, 2, 3, 1000000001, 1000000002, 1000000003, 77]) AS k), (SELECT unnest([1, 2, 3, 4, 5, 6, 9]) AS d), LATERAL (SELECT CASE WHEN k = 2 AND d > 3 THEN 5 WHEN k = 3 THEN 5 ELSE 0 END::BIGINT AS s)"""
    parts = "SELECT unnest([1, 2, 3, 1000000001, 1000000002, 1000000003])::BIGINT AS p_partkey, 'hot bolt' AS p_name, 'Brand#1' AS p_brand, 'LARGE' AS p_type, 7::INTEGER AS p_size, 9.0::DOUBLE AS p_retailprice"
    for name, sql in {"lineitem": lines, "part": parts, "supplier": f"FROM '{halves}/supplier.parquet'", "nation": f"FROM '{halves}/nation.parquet'"}.items():
        duckdb.connect().execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["silver_products", "audit_mart", "audit_incremental"])
def test_lines_that_find_nothing(spark, gaps, name):
    sql = catalogue.ORACLES[name]
    assert_same(catalogue.QUERIES[name](spark, gaps), sql, gaps)


@pytest.mark.parametrize("name", ["silver_products", "dim_product"])
def test_lines_are_cut_before_they_get_wide(spark, tiny, name):
    """Each part's newest lines are chosen before the join with parts, so that what is shuffled of every line is narrow."""
    plan = catalogue.QUERIES[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cuts = [i for i, line in enumerate(plan) if "WindowGroupLimit [l_partkey" in line]
    part = next(i for i, line in enumerate(plan) if "p_partkey" in line and "Relation" in line)
    join = next(i for i, line in enumerate(plan) if "Join Inner, (l_partkey" in line)
    assert cuts and join < cuts[0] < part


def test_incremental_audit_stores_no_raw_rows(spark, tiny, monkeypatch):
    names, kept = [], catalogue.storage.stored
    monkeypatch.setattr(catalogue.storage, "stored", lambda df, name: names.append(name) or kept(df, name))
    catalogue.QUERIES["audit_incremental"](spark, tiny)
    assert "raw" not in names


def test_lines_of_pages_are_collected_once_dealt_out(spark, tiny):
    """No partial collecting, which would sort all rows and save nothing, before lines are dealt out to their pages."""
    plan = catalogue.QUERIES["flatten_pages"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    top, _, below = plan.partition("Exchange hashpartitioning(l_orderkey")
    assert below and "ObjectHashAggregate" in top and "ObjectHashAggregate" not in below
