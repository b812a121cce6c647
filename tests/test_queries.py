"""Every query with a SQL counterpart, compared with DuckDB at the smallest scale; and plans of the main ones."""

import math
import re

import duckdb
import pytest

from checks import CHECKS
from checks.fixture import StoredTables, Tables
from evengap.plans import headways, trip_features

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def stored(spark):
    return StoredTables(spark, FOLDER)


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


@pytest.mark.parametrize("name", [n for n, c in CHECKS.items() if c.sql is not None])
def test_query_equals_sql(stored, duck, name):
    check = CHECKS[name]
    got = check.answer(stored)
    result = duck.execute(check.oracle())
    columns = [d[0] for d in result.description]
    assert got.columns == columns
    want = sorted([plain(v) for v in row] for row in result.fetchall())
    assert sorted([plain(v) for v in row] for row in got.collect()) == want


def test_entry_runs(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 and all(0 <= r["pct_bunched"] <= 100 for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("table", ["hw", "trips", "ds", "extra", "sequences", "test"])
def test_no_nested_loops_or_single_partition(spark, table):
    plan = plan_of(getattr(Tables(spark, FOLDER), table))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "Exchange SinglePartition" not in plan


def test_headways_shuffle_twice(spark, stored):
    plan = plan_of(headways(stored.events))
    assert plan.count("Exchange hashpartitioning") == 2


def test_history_labels_and_medians_share_the_trip_shuffle(spark, stored):
    """One shuffle for all trip windows, and two for the stop medians (aggregate and join)."""
    plan = plan_of(trip_features(stored.hw))
    assert plan.count("Exchange hashpartitioning(date") == 1
    assert plan.count("Exchange") <= 3


def test_scan_reads_only_what_is_used(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = plan_of(Tables(spark, FOLDER).hw.select("headway_sched"))
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "l_orderkey" in read and "l_returnflag" not in read and "l_tax" not in read


def test_model_table_deals_the_events_once(spark):
    """Stops, stop medians and weather read the shuffle of the events; before, stops and weather made another one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(Tables(spark, FOLDER).ds)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = [line for line in plan.splitlines() if re.search(r"- Exchange hashpartitioning\((\(l_orderkey|trip_id)", line)]
    assert len(dealt) == 2  # the other one holds a month, for the route counts
    assert plan.count("ReusedExchange [l_orderkey") >= 3
