"""Every registered query against its checking SQL, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as driver
from check import compare
from gridloom.workload import ORACLES, QUERIES
from gridloom.workload.views import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    _, _, problem = compare(spark, con, SF_DIR, name)
    assert problem is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries())


SPATIAL = ["clip_polygon", "clip_features", "clip_buffer", "bounds_filter", "reclip_composite", "regrid_nearest"]
KEYED = ["poll_merge", "run_report", "manifest_rollup", "missing_outputs", "admission_list", "planned_composite"]


@pytest.mark.parametrize("name", SPATIAL + KEYED)
def test_same_result_without_broadcast(spark, con, no_broadcast, name):
    _, _, problem = compare(spark, con, SF_DIR, name)
    assert problem is None


@pytest.mark.parametrize("name", SPATIAL + KEYED)
def test_no_cross_join_even_without_broadcast(spark, no_broadcast, name):
    plan = driver.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["dataset_id", "part", "year", "row", "col", "band_a", "band_b", "qa"]
    assert df.count() > 0
