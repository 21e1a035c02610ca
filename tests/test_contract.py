"""Every query with a twin against DuckDB at the smallest scale, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from escalade.contract import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


SLOW = {"select_on_dev", "fit_refit_evaluate", "router_report", "logistic_router"}


@pytest.mark.parametrize("key", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf, con, key):
    got = entry.queries()[key](spark, sf).toPandas()
    if key in ORACLE:
        assert compare(got, con.execute(ORACLE[key]).df()) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scan_is_pruned(spark, sf):
    text = plan(QUERIES["coverage_table"](spark, sf))
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "lineitem" in line]
    assert scans and all("l_extendedprice" not in s and "l_comment" not in s for s in scans)


@pytest.mark.parametrize("key", ["coverage_table", "routing_summary", "auroc", "reconcile_by_text", "route_flow", "interaction_ci", "stratified_split"])
def test_no_nested_loop_or_cross_join(spark, sf, key):
    text = plan(QUERIES[key](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_n_never_sorts_everything(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["source_breakdown"](spark, sf))
    assert "WindowGroupLimit" in plan(QUERIES["last_n_attempts"](spark, sf))
