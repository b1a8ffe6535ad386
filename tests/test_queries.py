"""Every registered query against its SQL twin, and the shape of its plan."""

from __future__ import annotations

import pytest
from compare import compare
from conftest import SF_DIR

import __spark_entry__ as entry
from sigward.plans import registry

# The inventory's queries; those of optional packages have tests of their own.
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES.get(name)) == ""


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [q for q in QUERIES if not q.startswith(("s1", "t"))])
def test_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", [q for q in QUERIES if not q.startswith(("s1", "t"))])
def test_python_runs_only_in_the_limiters(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    python = any(node in plan for node in ("MapInPandas", "EvalPython", "FlatMapGroupsInPandas", "MapInArrow"))
    assert python == (name in ("w7_limit_restarts", "w8_suppress_alerts", "c4_watchdog"))


def test_scan_is_one_narrow_pass(spark, tables):
    """The only exchange is the one that spreads a single small file over the cores."""
    from sigward.plans import views as V

    plan = plan_of(V.matches(tables))
    assert plan.count("Exchange") == 1 and "RoundRobinPartitioning" in plan


def test_quarantine_leaves_contents_where_they_were_read(tables):
    from sigward.plans import views as V

    plan = plan_of(V.quarantine(tables))
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["f6_on_date"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_rank_limits_run_before_the_shuffle(spark):
    """A key that holds most rows reaches its task as a few rows per map task."""
    assert "partial_min" in plan_of(QUERIES["w1_dedupe_first"](spark, SF_DIR))
    for name in ("w2_dedupe_rules_by_name", "w3_flatten_by_name", "w4_last_n"):
        plan = plan_of(QUERIES[name](spark, SF_DIR))
        assert "WindowGroupLimit" in plan and "Partial" in plan, name
