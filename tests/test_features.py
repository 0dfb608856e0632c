import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillflow.functions import clip, half_even, nearest, percent_of, ratio
from tillflow.operators.features import engineer_features

D = Decimal


def derive(spark, schema, *rows):
    return engineer_features(spark.createDataFrame(list(rows), schema)).collect()


def test_discount_band_edges(spark):
    edges = ["-0.02", "-0.01", "0", "0.1", "0.1001", "0.2", "0.3", "0.3001", "1", "1.01", None]
    rows = derive(spark, "discount decimal(9,4)", *[(None if e is None else D(e),) for e in edges])
    assert [r.discount_band for r in rows] == [
        None, "low", "low", "low", "medium", "medium", "high", "very_high", "very_high", None, None,
    ]
    assert rows[4].discount_percentage == D("10.01")


def test_margin_is_limited_and_null_stays_null(spark):
    pairs = [("10", "4"), ("10", "-4"), ("10", "40"), ("0", "4"), (None, "4"), ("10", None), ("-10", "-4")]
    rows = derive(
        spark, "sales decimal(18,4), profit decimal(18,4)", *[tuple(None if v is None else D(v) for v in p) for p in pairs]
    )
    assert [r.profit_margin for r in rows] == [0.4, 0.0, 1.0, None, None, None, 0.4]
    assert [r.profitability_flag for r in rows] == [True, False, True, True, True, False, False]


def test_calendar(spark):
    days = [dt.date(2016, 11, 8), dt.date(2016, 11, 12), dt.date(2016, 11, 13), dt.date(2016, 11, 14), None]
    rows = derive(spark, "order_date date", *[(d,) for d in days])
    assert [r.weekend_flag for r in rows] == [False, True, True, False, False]
    assert (rows[0].order_year, rows[0].order_month, rows[0].order_month_name, rows[0].order_quarter) == (2016, 11, "November", 4)
    assert (rows[4].order_year, rows[4].order_month_name) == (None, None)


def test_all_month_names(spark):
    rows = derive(spark, "order_date date", *[(dt.date(2020, m, 1),) for m in range(1, 13)])
    assert [r.order_month_name for r in rows] == [dt.date(2020, m, 1).strftime("%B") for m in range(1, 13)]


def test_shipping_days(spark):
    d = dt.date(2020, 1, 10)
    rows = derive(
        spark, "order_date date, ship_date date",
        (d, dt.date(2020, 1, 13)), (d, dt.date(2020, 1, 9)), (d, None), (None, d),
    )
    assert [r.shipping_days for r in rows] == [3, 0, None, None]


def test_revenue_per_unit(spark):
    rows = derive(spark, "sales decimal(18,4), quantity long", (D("10"), 4), (D("10"), 0), (None, 1), (D("10"), None))
    assert [r.revenue_per_unit for r in rows] == [2.5, None, None, None]


def test_only_what_the_columns_allow(spark):
    assert engineer_features(spark.createDataFrame([("x",)], "city string")).columns == ["city"]


def test_features_need_no_shuffle(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2020, 1, 2), D(1), D(1), 1, D(0))],
                               "order_date date, ship_date date, sales decimal(18,4), profit decimal(18,4), quantity long, discount decimal(9,4)")
    plan = engineer_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("value, low, high, result", [(None, 0, 1, None), (-3, 0, None, 0), (7, 0, 5, 5), (2, 0, 5, 2)])
def test_clip(spark, value, low, high, result):
    df = spark.createDataFrame([(value,)], "v int")
    assert df.select(clip(F.col("v"), low, high)).first()[0] == result


def test_rounding_rules(spark):
    df = spark.createDataFrame([(D("1.00"), D("8.00"), 0.125, 2.675)], "p decimal(12,2), w decimal(12,2), a double, b double")
    row = df.select(
        ratio(F.col("p"), F.col("w"), 2), half_even(F.col("a"), 2), half_even(F.col("b"), 2),
        ratio(F.col("p"), F.lit(D("0.00")), 2), percent_of(F.col("p"), F.col("w")), percent_of(F.col("p"), F.lit(0)),
    ).first()
    assert tuple(row) == (D("0.13"), 0.12, 2.68, None, 12.5, None)


def test_nearest_decimal_of_a_double(spark):
    shares = [missing / rows * 100 for rows in (8, 3000, 4000, 60_000) for missing in range(0, rows, max(1, rows // 500))]
    values = [*shares, 2.675, 0.005, 0.125, 0.375, 1.005, 99.995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(nearest(F.col("v"), 2)).collect()] == [round(v, 2) for v in values]
