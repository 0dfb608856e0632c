"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as spark_entry
from checks import catalog, oracle
from checks.compare import connect, difference
from checks.workspace import workspace
from tests.conftest import MEDIUM, SMALL

NAMES = list(catalog.builds())
EXPECTED_BANDS = {  # known totals at the medium scale
    "low": (9487, 789055806.89, 570116898.33, 0.7225),
    "medium": (10539, 962489894.08, 589025533.36, 0.6120),
    "high": (8196, 635440871.90, 326246154.68, 0.5134),
    "very_high": (9419, 796269698.76, 336952692.31, 0.4232),
}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(NAMES) <= set(spark_entry.queries()) and set(NAMES) == set(oracle.statements()) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert difference(spark, duck, SMALL, name) is None


def test_entry(spark):
    rows = spark_entry.entry(spark).collect()
    assert len(rows) == 5 and sorted(r.sales_rank for r in rows) == [1, 2, 3, 4, 5]


def test_known_totals(spark):
    rows = catalog.queries()["discount_impact"](spark, MEDIUM).collect()
    got = {r.discount_band: (r.total_orders, r.total_sales, r.total_profit, r.profit_margin) for r in rows}
    assert got == EXPECTED_BANDS


@pytest.mark.parametrize("name", [*catalog.ORDER_REPORTS, *catalog.SELECTED_REPORTS, "clean", "quality_report", "warehouse_schema"])
def test_plans_stay_in_the_engine(spark, name):
    plan = catalog.builds()[name](workspace(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_detail_lines_are_not_gathered_in_one_task(spark):
    plan = catalog.builds()["vw_sales_summary"](workspace(spark, SMALL))._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan.split("Subquery")[0]


RANKED = ["vw_customer_summary", "vw_product_performance", "segment_customer_rank", "product_double_rank", "rfm_scores"]


@pytest.mark.parametrize("name", [*RANKED, *(f"{n}_refreshed" for n in RANKED)])
def test_ranks_over_many_ranges(spark, duck, conf, name):
    """As on a large table: about ten rows to a range."""
    conf(spark__sql__shuffle__partitions=40)
    assert difference(spark, duck, SMALL, name) is None


@pytest.mark.parametrize("partitions", [1, 64])
@pytest.mark.parametrize("name", ["vw_product_performance", "rfm_segment", "basket_pairs", "quality_report"])
def test_results_do_not_depend_on_partitioning(spark, duck, conf, name, partitions):
    conf(spark__sql__shuffle__partitions=partitions)
    assert difference(spark, duck, SMALL, name) is None
