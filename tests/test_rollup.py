"""Roll-ups with order bitmaps against counts over the lines."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tillflow.operators import rollup
from tillflow.operators.filters import Selection, select_orders
from tillflow.scratch import new_path


def made(n, seed=5):
    """Lines of orders that span days, regions and categories; one order, and lines without one, hold a third each."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        order = rng.choice([None, "O-hot", f"O-{rng.randrange(n // 4)}"])
        day = rng.choice([None, dt.date(2017, 1, 1 + rng.randrange(9))])
        rows.append({
            "row_id": i, "order_id": order, "order_date": day, "order_year": day and day.year, "region": rng.choice([None, "N", "S"]),
            "segment": rng.choice(["A", "B"]), "category": rng.choice(["x", "y", "z"]), "sales": Decimal(rng.randrange(10_000)) / 100,
            "quantity": rng.randrange(5), "shipping_days": rng.choice([None, 1, 4]),
        })
    return rows


def wanted(rows, key):
    groups = {}
    for r in rows:
        groups.setdefault(r[key], []).append(r)
    return {
        k: (len({r["order_id"] for r in g} - {None}), sum(r["sales"] for r in g), sum(r["quantity"] for r in g), len(g))
        for k, g in groups.items()
    }


def got(rolled, key):
    rows = rollup.summarize(rolled, key).collect()
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: (r.distinct_orders, r.sales, r.quantity, r["lines"]) for r in rows}


@pytest.mark.parametrize("key", ["region", "category", "order_date", "segment"])
def test_sums_and_distinct_orders(spark, warehouse, key):
    rows = made(600)
    lines = warehouse(*rows)
    assert got(rollup.roll_up(lines, rollup.number_orders(lines)), key) == wanted(rows, key)


def test_numbers_are_dense_and_close_by_day(spark, warehouse):
    lines = warehouse(*[r for r in made(600) if r["order_date"]])
    numbers = {r.order_id: r.number for r in rollup.number_orders(lines).collect()}
    assert sorted(numbers.values()) == list(range(1, len(numbers) + 1)) and None not in numbers
    first = {}
    for r in lines.where("order_id IS NOT NULL").collect():
        first[r.order_id] = min(first.get(r.order_id, r.order_date), r.order_date)
    days = [first[o] for o in sorted(numbers, key=numbers.get)]
    assert days == sorted(days)


def test_appended_lines_equal_one_load(spark, warehouse):
    rows, path = made(800), new_path(spark, "rollup")
    rollup.write_rollup(warehouse(*rows[:300]), path)
    before = {r.order_id: r.number for r in spark.read.parquet(f"{path}/numbers").collect()}
    rolled = rollup.append_rollup(warehouse(*rows[300:]), path)
    after = {r.order_id: r.number for r in spark.read.parquet(f"{path}/numbers").collect()}
    assert before.items() <= after.items() and sorted(after.values()) == list(range(1, len(after) + 1))
    for key in ("region", "category"):
        assert got(rolled, key) == wanted(rows, key)


def test_orders_in_several_ranges_of_numbers(spark, warehouse):
    """Numbers that begin just below the end of a bitmap."""
    rows = made(600)
    lines = warehouse(*rows)
    known = spark.createDataFrame([("old", 32_700)], "order_id string, number long")
    rolled = rollup.roll_up(lines, rollup.number_orders(lines, known))
    assert rolled.where("bucket IS NOT NULL").select("bucket").distinct().count() == 2
    assert got(rolled, "region") == wanted(rows, "region")


def test_selection(spark, warehouse):
    rows = made(600)
    lines, chosen = warehouse(*rows), Selection(regions=("N",), start=dt.date(2017, 1, 3), end=dt.date(2017, 1, 6))
    rolled = select_orders(rollup.roll_up(lines, rollup.number_orders(lines)), chosen)
    kept = [r for r in rows if r["region"] == "N" and r["order_date"] and 3 <= r["order_date"].day <= 6]
    assert got(rolled, "category") == wanted(kept, "category")


def test_empty_table(spark, warehouse):
    lines = warehouse()
    rolled = rollup.roll_up(lines, rollup.number_orders(lines))
    assert rollup.summarize(rolled, "region").count() == 0
    assert [r.distinct_orders for r in rollup.summarize(rolled).collect()] == [0]


def test_lines_travel_to_their_number_and_to_their_bitmap_only(spark, warehouse, conf):
    """Where the join with the numbers shuffles, sums by order need no shuffle of their own."""
    conf(spark__sql__autoBroadcastJoinThreshold=-1)
    lines, numbers = warehouse(*made(50)), spark.createDataFrame([("O-hot", 1)], "order_id string, number long")
    plan = rollup.roll_up(lines, numbers)._jdf.queryExecution().executedPlan().toString()
    exchanges = [text for text in plan.splitlines() if "Exchange hashpartitioning" in text]
    assert len(exchanges) == 4  # lines and numbers to the join, lines without an order, and sums to bitmaps
    assert not any("order_id#" in text and "order_date#" in text for text in exchanges), exchanges


def test_written_lines_travel_as_two_numbers_and_bitmaps_stay(spark, warehouse, monkeypatch):
    """Ten dimensions are two numbers until the cells are written, and cells are written where their bitmaps are made."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows, seen, made_of = made(600), [], rollup.roll_up
    monkeypatch.setattr(rollup, "roll_up", lambda lines, numbers, dimensions: (seen.append(lines), made_of(lines, numbers, dimensions))[1])
    monkeypatch.setattr(DataFrame, "repartitionByRange", None)
    lines = warehouse(*rows)
    rolled = rollup.write_rollup(lines, new_path(spark, "rollup"))
    assert not set(seen[0].columns) & set(rollup.DIMENSIONS)
    assert {c for c, t in seen[0].dtypes if c.startswith("_") and t == "bigint"} == {"_day", "_kind"}
    for key in ("region", "category", "order_date"):
        assert got(rolled, key) == wanted(rows, key)
    plain = made_of(lines, rollup.number_orders(lines))
    assert rolled.dtypes == plain.dtypes
    assert rolled.exceptAll(plain).count() == 0 and rolled.count() == plain.count()
    for file in rolled.inputFiles():
        days = [r[0] for r in spark.read.parquet(file).coalesce(1).select("order_date").collect()]
        assert days == sorted(days, key=lambda d: (d is not None, d or dt.date.min))


def test_bitmaps_are_made_after_the_shuffle(spark, warehouse):
    """A bitmap of 4 KB per map task and group would be the larger part of the shuffle."""
    lines = warehouse(*made(50))
    plan = rollup.roll_up(lines, rollup.number_orders(lines))._jdf.queryExecution().executedPlan().toString()
    lines_of_plan = plan.splitlines()
    last = max(i for i, text in enumerate(lines_of_plan) if "bitmap_construct_agg" in text)
    first_exchange = min(i for i, text in enumerate(lines_of_plan) if "Exchange" in text)
    assert last < first_exchange
    assert all(node not in plan for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"))
