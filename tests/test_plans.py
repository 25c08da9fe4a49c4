"""What plans of the report family may hold."""

import os

import pytest

from panelyard.plans.all_queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def counted(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    prepared = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return prepared.count("Exchange hashpartitioning"), plan.count("orders.parquet")


@pytest.mark.parametrize(("name", "most"), [("report_entry", 10), ("report_lint_v2", 15), ("report_issues", 10), ("repaired_drafts", 10)])
def test_reports_are_planned_on_one_state(spark, name, most):
    """The state is written once: orders aren't read again, and few exchanges are left."""
    exchanges, scans = counted(spark, name)
    assert exchanges <= most and scans == 0
