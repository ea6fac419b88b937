"""Every registered query against its SQL on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracle import rows_of  # noqa: E402

from touchline.queries.oracle import ORACLE  # noqa: E402
from touchline.queries.registry import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
WITHOUT_SQL = {"train_score"}
TRAINING = {"train_score", "train_score_checks"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL and set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, name):
    frame = contract.queries()[name](spark, SF_DIR)
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ["geo_lookup", "team_attrs", "rejected_names", "results_model_ready", "plan_expansion"])
def test_without_any_broadcast(spark, db, name):
    """Reference tables too large to broadcast take the sort-merge way to the same rows."""
    switches = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for switch in switches:
            spark.conf.set(switch, "-1")
        frame = contract.queries()[name](spark, SF_DIR)
        got = rows_of(frame.columns, frame.collect())
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        for switch in switches:
            spark.conf.unset(switch)
    cursor = db.execute(contract.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINING - {"auc"}))
def test_plan(spark, name):
    """No pair-emitting joins anywhere, and Python only where pages are parsed."""
    plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert name == "extract_pages" or "Python" not in plan and "MapInArrow" not in plan


def test_filters_reach_the_scan(spark):
    frame = contract.queries()["table_scan_filter"](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters: [isnotnull(o_totalprice" in plan
    assert "PushedFilters: [IsNotNull(o_totalprice), IsNotNull(o_orderpriority), GreaterThan(o_totalprice" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderpriority:string>" in plan


def test_train_score(spark):
    out = contract.queries()["train_score"](spark, SF_DIR)
    assert out.columns == ["ID", "homewin_v1", "pointdiff_v1"]
    assert out.where("homewin_v1 not between 0 and 1 or homewin_v1 is null").isEmpty() and not out.isEmpty()


def test_entry(spark):
    out = contract.entry(spark)
    assert not out.isEmpty() and "Diff_FormWinRate" in out.columns
