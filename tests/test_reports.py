import datetime as dt
from decimal import Decimal

import pytest

from tillflow.plans import business, dashboard, exploration, views

D = Decimal


def month(year, number, sales, **more):
    return dict(order_date=dt.date(year, number, 1), order_year=year, order_month=number,
                order_month_name=dt.date(year, number, 1).strftime("%B"),
                sales=None if sales is None else D(sales), profit=D(1), order_id=f"{year}{number}", **more)


def test_growth_compares_months_present(warehouse):
    df = warehouse(month(2020, 1, 100), month(2020, 3, 150), month(2020, 4, 0), month(2020, 5, 0), month(2020, 6, 10),
                   month(2020, 7, 15))
    rows = dashboard.month_growth(df).orderBy("order_month").collect()
    assert [r["mom_growth_%"] for r in rows] == [0.0, 50.0, -100.0, 0.0, None, 50.0]
    assert rows[0].month_year == "January 2020"


def test_dashboard_drops_null_groups_and_views_keep_them(warehouse):
    df = warehouse(dict(region="N", sales=D(5), profit=D(1), order_id="a"), dict(sales=D(7), profit=D(1), order_id="b"),
                   dict(region="Z", order_id="c"))
    assert {r.region: r.revenue for r in dashboard.region(df).collect()} == {"N": 5, "Z": 0}
    kept = {r.region: (r.total_sales, r.sales_rank) for r in views.region_performance(df).collect()}
    assert kept == {"Z": (None, 1), None: (7, 2), "N": (5, 3)}  # a NULL sum ranks first


def test_zero_revenue_has_no_margin(warehouse):
    df = warehouse(dict(region="N", sales=D(0), profit=D(-3), order_id="a"))
    assert dashboard.region(df).first()["margin_%"] is None
    assert views.region_performance(df).first().profit_margin is None
    assert dashboard.kpis(df).first().gross_margin == 0


def test_kpis_of_nothing(warehouse):
    df = warehouse(dict(region="N")).limit(0)
    assert tuple(dashboard.kpis(df).first()) == (0, 0, 0, 0.0, 0.0)
    assert tuple(business.executive_kpis(df).first()) == (None, None, 0, None, None)


def test_group_margin_is_not_limited(warehouse):
    df = warehouse(dict(category="C", sales=D(10), profit=D(-20), order_id="a"))
    assert views.category_performance(df).first().profit_margin == -2


def test_running_total_and_four_month_average(warehouse):
    df = warehouse(*[month(2020, m, m * 10) for m in range(1, 7)], month(2021, 1, 60))
    rows = views.monthly_sales(df).collect()
    assert [r.running_sales for r in rows] == [10, 30, 60, 100, 150, 210, 270]
    assert [float(r.moving_avg_sales) for r in rows] == [10, 15, 20, 25, 35, 45, 52.5]


def test_null_month_comes_last(warehouse):
    rows = views.monthly_sales(warehouse(month(2020, 1, 10), dict(sales=D(5), order_id="x"))).collect()
    assert [(r.order_year, r.running_sales) for r in rows] == [(2020, 10), (None, 15)]


def test_shipping(warehouse):
    df = warehouse(dict(ship_mode="Same Day", shipping_days=1, sales=D(1), order_id="a"),
                   dict(ship_mode=None, shipping_days=6, sales=D(2), order_id="b"),
                   dict(ship_mode="Second Class", shipping_days=None, sales=D(3), order_id="c"))
    groups = {r.ship_mode: r.shipping_group for r in views.shipping_analysis(df).collect()}
    assert groups == {"Same Day": "Priority", None: "Standard", "Second Class": "Standard"}
    speed = {r.ship_mode: r.shipping_efficiency for r in business.shipping_efficiency(df).collect()}
    assert speed == {"Same Day": "Efficient", None: "Slow", "Second Class": "Efficient"}


def test_customer_in_two_regions_is_two_rows(warehouse):
    who = dict(customer_id="c", customer_name="C", segment="S", profit=D(1))
    df = warehouse(dict(region="A", sales=D(5), order_id="1", **who), dict(region="B", sales=D(5), order_id="2", **who))
    assert [r.sales_rank for r in views.customer_summary(df).collect()] == [1, 1]


def test_weekend_labels(warehouse):
    df = warehouse(dict(weekend_flag=True, order_id="a", shipping_days=4), dict(weekend_flag=False, order_id="b"))
    assert {r.order_day_type: r.avg_transit_days for r in dashboard.weekend(df).collect()} == {
        "Weekend Order": 4.0, "Weekday Order": None,
    }


def test_alphabetical_months(warehouse):
    rows = exploration.monthly_by_name(warehouse(month(2020, 1, 1), month(2020, 4, 1), month(2020, 12, 1))).collect()
    assert [r.order_month_name for r in rows] == ["April", "December", "January"]


@pytest.mark.parametrize("report", [business.top_customers_by_sales, dashboard.top_customers_by_profit])
def test_top_ten_ties_go_to_the_smaller_name(warehouse, report):
    rows = [dict(customer_name=f"n{i:02d}", segment="S", region="R", sales=D(1), profit=D(1), order_id=str(i)) for i in range(15)]
    assert [r.customer_name for r in report(warehouse(*reversed(rows))).collect()] == [f"n{i:02d}" for i in range(10)]


def test_shares_add_up(warehouse):
    df = warehouse(dict(segment="A", sales=D(75), profit=D(15)), dict(segment="B", sales=D(25), profit=D(-5)))
    rows = {r.segment: (r["share_%"], r["margin_%"]) for r in exploration.segment_share(df).collect()}
    assert rows == {"A": (75.0, 20.0), "B": (25.0, -20.0)}


def test_correlations_against_plain_definitions(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, 400) * 5
    y = np.round(rng.normal(size=400) - x / 30, 4)
    rows = [(Decimal(int(a)), Decimal(str(b))) for a, b in zip(x, y, strict=True)] + [(None, Decimal(1)), (Decimal(5), None)]
    df = spark.createDataFrame(rows, "discount_percentage decimal(6,2), profit_margin decimal(6,4)")
    found = dashboard.discount_margin_correlation(df).first()
    pair = pd.DataFrame({"x": x, "y": y})
    assert found["lines"] == 400
    assert found["pearson"] == pytest.approx(pair.corr().iloc[0, 1], abs=1e-8)
    assert found["spearman"] == pytest.approx(pair.rank().corr().iloc[0, 1], abs=1e-8)
    assert tuple(dashboard.discount_margin_correlation(df.limit(0)).first()) == (0, None, None)
    assert tuple(dashboard.discount_margin_correlation(df.where("discount_percentage = 5")).first())[1:] == (None, None)
