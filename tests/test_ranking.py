from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from tillflow.operators.ranking import add_ranks, cell_sql, number_rows, rows_at


def plain_rank(df, partition_by=()):
    return F.rank().over(Window.partitionBy(*partition_by).orderBy(F.col("v").desc_nulls_first()))


def table(spark, kind, n=5000):
    value = {
        "unique": "id * 7919 % 100003",
        "ties": "id % 37",
        "hot_value": "if(id % 3 = 0, 50, id % 997)",
        "hot_null": "if(id % 3 = 0, NULL, id % 997)",
        "one_value": "5",
        "all_null": "NULL",
        "extremes": "if(id % 2 = 0, -1e12, 1e12) + id % 11",
    }[kind]
    owner = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE string(id % 4) END"
    return spark.range(n, numPartitions=6).selectExpr("id", f"{owner} AS p", f"CAST({value} AS decimal(20,2)) AS v")


KINDS = ["unique", "ties", "hot_value", "hot_null", "one_value", "all_null", "extremes"]


@pytest.mark.parametrize("kind", KINDS)
def test_rank_equals_plain_window(spark, kind):
    df = table(spark, kind)
    both = add_ranks(df, {"v": "r"}).join(df.select("id", plain_rank(df).alias("x")), "id")
    assert both.count() == 5000 and both.where("r <> x").count() == 0


@pytest.mark.parametrize("kind", KINDS)
def test_partitioned_rank_equals_plain_window(spark, kind):
    df = table(spark, kind)
    both = add_ranks(df, {"v": "r"}, partition_by=["p"]).join(df.select("id", plain_rank(df, ["p"]).alias("x")), "id")
    assert both.count() == 5000 and both.where("r <> x").count() == 0


def test_several_metrics(spark):
    df = table(spark, "hot_null").withColumn("w", F.col("id") % 41 - 20.5)
    second = F.rank().over(Window.orderBy(F.col("w").desc_nulls_first()))
    ranked = add_ranks(df, {"v": "r", "w": "q"})
    both = ranked.join(df.select("id", plain_rank(df).alias("x"), second.alias("y")), "id")
    assert both.count() == 5000 and both.where("r <> x OR q <> y").count() == 0
    assert ranked.columns == ["id", "p", "v", "w", "r", "q"] and dict(ranked.dtypes)["r"] == "bigint"


def test_rank_of_nothing(spark):
    assert add_ranks(table(spark, "ties", 0), {"v": "r"}).count() == 0


def test_cells_are_in_the_order_of_their_values(spark):
    values = [float("-inf"), -1e300, -5.0, -1.0, -0.3, -1e-300, 0.0, 5e-324, 1e-300, 0.01, 0.99, 1.0, 1.0000001, 3.0, 1e17, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = [r[0] for r in df.orderBy("i").select(F.expr(cell_sql("v", "high"))).collect()]
    assert cells == sorted(cells) and len(set(cells)) >= len(cells) - 2
    exact = spark.range(200_000).selectExpr("CAST(id - 100000 AS decimal(20,2)) / 100 AS v")
    steps = exact.select(F.expr(cell_sql("v", "high")).alias("c"), "v").withColumn("before", F.lag("c").over(Window.orderBy("v")))
    assert steps.where("before > c").count() == 0
    sizes = exact.groupBy(F.expr(cell_sql("v", "high"))).count().agg(F.max("count")).first()[0]
    assert sizes < 200_000 / 90  # even values: the widest cell is one percent of each half


def test_work_is_even_whatever_the_values(spark):
    """Equal values are counted before anything is ordered: a value of a third of the rows is one row of its cell."""
    df = table(spark, "hot_value", 30_000)
    lines = add_ranks(df, {"v": "r"})._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(lines) if "Window [" in line]
    assert len(windows) == 2
    for i in windows:  # nearest below a window is the grouping of values or of cells
        below = next(line for line in lines[i + 1 :] if any(x in line for x in ("Aggregate", "Range", "Join")))
        assert "Aggregate" in below or "Join" in below


def test_building_starts_no_job(spark, warehouse):
    from tillflow.plans import business, views

    tracker = spark.sparkContext.statusTracker()
    orders = warehouse(dict(region="R", sales=Decimal(1), order_id="a"))
    spark.sparkContext.setJobGroup("building", "queries are built")
    try:
        for build in (*views.VIEWS.values(), business.segment_customer_rank, business.product_double_rank):
            build(orders)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_ranked_reports_scan_the_orders_once(spark):
    """In the plan that has run, groupings of the orders stated several times are one."""
    from checks.workspace import workspace
    from tests.conftest import SMALL
    from tillflow.plans import business, views

    orders = workspace(spark, SMALL).orders
    for build in (views.customer_summary, views.product_performance, business.segment_customer_rank, business.product_double_rank):
        report = build(orders)
        report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0]
        reused = final.count("ReusedExchange")
        assert final.count("FileScan") - reused <= 1 or reused >= 1, final
        for i, line in enumerate(plan.splitlines()):
            if "SinglePartition" in line:
                assert "_cell" in plan.splitlines()[i + 1] or "HashAggregate(keys=[]" in plan.splitlines()[i + 1]


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_rank_does_not_depend_on_partitioning(spark, conf, partitions):
    conf(spark__sql__shuffle__partitions=partitions)
    df = table(spark, "hot_value", 2000).orderBy(F.rand(partitions))
    both = add_ranks(df, {"v": "r"}).join(df.select("id", plain_rank(df).alias("x")), "id")
    assert both.where("r <> x").count() == 0


def shuffle_without_coalescing(conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions=6)


@pytest.mark.parametrize("kind", ["unique", "one_value", "hot_value"])
def test_row_numbers(spark, conf, kind):
    shuffle_without_coalescing(conf)
    df = table(spark, kind, 3000)
    rows = number_rows(df, [F.col("v").asc(), F.col("id").asc()], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 3001))
    assert [(r.v, r.id) for r in rows] == sorted((r.v, r.id) for r in rows)


def test_row_numbers_beside_chosen_columns(spark, conf):
    """What only orders the rows is not written."""
    shuffle_without_coalescing(conf)
    df = table(spark, "ties", 3000)
    order = [F.col("v").asc(), F.col("id").asc()]
    whole, kept = number_rows(df, order, "n"), number_rows(df, order, "n", keep=["id"])
    assert kept.columns == ["n", "id"] and kept.exceptAll(whole.select("n", "id")).count() == 0 and kept.count() == 3000
    assert "v" not in spark.read.parquet(kept.inputFiles()[0]).columns


@pytest.mark.parametrize("kind", KINDS)
def test_rows_at_positions(spark, conf, kind):
    shuffle_without_coalescing(conf)
    df = table(spark, kind, 3000).withColumn("w", (F.col("id") % 3).cast("decimal(20,2)"))
    positions = [1, 2, 600, 1200, 1500, 1999, 2999, 3000]
    found = rows_at(df, ["v", "w"], ["id"], {"v": positions, "w": [3000, 17]})
    for metric, wanted in (("v", positions), ("w", [3000, 17])):
        expected = sorted(((r[metric] is not None, r[metric] or 0, r.id) for r in df.collect()))
        for p in wanted:
            row = found[metric, p]
            assert (row["_value"] is not None, row["_value"] or 0, row["id"]) == expected[p - 1]


def test_rows_at_no_position(spark):
    assert rows_at(table(spark, "ties", 5), ["v"], ["id"], {"v": []}) == {}
