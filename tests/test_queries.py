"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from querybook.duckdb_sql import ORACLE
from querybook.spark_queries import QUERIES
from tests.compare import connect, differences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result_as_sql(spark, duck, name):
    text, _, _ = differences(spark, duck, SMALL, name, queries()[name], oracle_sql()[name])
    assert text == ""


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and len({r["specialty"] for r in rows}) == len(rows)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["specialty_summary", "attach_referral_decision", "code_detail", "period_compare", "decile_report",
             "decision_reason_xtab", "false_positive_dollars", "rule_table"],
)
def test_no_cross_join_and_no_python(spark, name):
    plan = _plan(queries()[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert operator not in plan


def test_scan_reads_only_needed_columns_and_pushes_filters(spark):
    plan = _plan(queries()["claims_cost_stats"](spark, SMALL))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "l_returnflag" in line)
    for column in ("l_quantity", "l_discount", "l_tax"):
        assert column not in scan
    header = _plan(queries()["referral_header_extract"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in header
