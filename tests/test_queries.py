"""Every named query of the catalogue gives the rows of its SQL."""

import os

import compare
import pytest

from lumengrid.plans.catalog import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF_DIR) == []


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["user_risk_tags", "hours_allocation", "plurality_first_seen", "learning_path"])
def test_partitioning_changes_nothing(spark, name):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, QUERIES[name](spark, SF_DIR).collect()))

    try:
        assert rows(1) == rows(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["user_subject_state"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "p_retailprice" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["formula_rules", "recommend_topk", "retrieve_topk", "user_risk_tags", "risk_score"])
def test_plans_stay_in_generated_code(spark, name):
    """With no way back to interpreted code, a method that outgrows 64 KB would fail the query."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert QUERIES[name](spark, SF_DIR).count() >= 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
