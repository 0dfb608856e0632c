import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SMALL
from tillflow.operators import rfm

D0 = dt.date(2020, 1, 1)


def test_quintile_ends_against_quantile_bins():
    for n in [*range(2, 400), 793, 1199, 1500, 14999]:
        bins = pd.qcut(np.arange(1, n + 1), 5, labels=False) + 1
        ends = rfm.quintile_ends(n)
        assert [1 + sum(r > e for e in ends) for r in range(1, n + 1)] == list(bins), n


def orders_of(warehouse, n):
    """Customers with repeated recency, frequency and monetary values, in no particular order."""
    rows = []
    for i in range(n):
        for k in range(1 + i % 3):
            day = D0 + dt.timedelta(days=(i * 7) % 4)
            rows.append(dict(customer_id=f"c{i * 37 % 101:03d}", customer_name=f"n{i % 2}", segment="S", region="R", category="C",
                             order_id=f"o{i}-{k}", order_date=day, order_year=2020, sales=Decimal(10 + i % 5)))
    return warehouse(*rows)


def expected(df):
    """Scores by ranking in order of customer, then quantile bins."""
    pdf = df.toPandas().sort_values(["customer_id", "customer_name", "segment"])
    bins = lambda s: pd.qcut(s.rank(method="first"), 5, labels=False) + 1
    pdf["monetary"] = pdf["monetary"].astype(float)
    return pdf.assign(r_score=6 - bins(pdf.recency), f_score=bins(pdf.frequency), m_score=bins(pdf.monetary))


@pytest.mark.parametrize("n", [2, 3, 5, 7, 12, 17, 30, 75])
def test_scores_match_quantiles_of_ranks(warehouse, n):
    base = rfm.rfm_base(orders_of(warehouse, n))
    want = {r.customer_id: (r.r_score, r.f_score, r.m_score) for r in expected(base).itertuples()}
    assert {r.customer_id: (r.r_score, r.f_score, r.m_score) for r in rfm.rfm_scores(base).collect()} == want


@pytest.mark.parametrize("partitions", [1, 5, 64])
def test_scores_with_several_ranges(warehouse, conf, partitions):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions=partitions)
    base = rfm.rfm_base(orders_of(warehouse, 60))
    want = {r.customer_id: (r.r_score, r.f_score, r.m_score) for r in expected(base).itertuples()}
    assert {r.customer_id: (r.r_score, r.f_score, r.m_score) for r in rfm.rfm_scores(base).collect()} == want


def test_money_is_compared_in_all_its_places(spark):
    """Ten customers whose money differs in the third and fourth place only, in reverse order of their ids."""
    money = [Decimal("10.0036") - Decimal("0.0004") * i for i in range(10)]
    rows = [(f"c{i}", "n", "S", i, 1, m) for i, m in enumerate(money)]
    base = spark.createDataFrame(rows, "customer_id string, customer_name string, segment string, recency int, frequency long, monetary decimal(28,4)")
    scores = [r.m_score for r in rfm.rfm_scores(base).orderBy("customer_id").collect()]
    assert scores == [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]


def test_one_customer_and_none(warehouse):
    orders = orders_of(warehouse, 1)
    row = rfm.rfm(orders).first()
    assert (row.r_score, row.f_score, row.m_score) == (5, 1, 1)
    assert rfm.rfm(orders.limit(0)).collect() == []


def test_base(warehouse):
    rows = [
        dict(customer_id="a", customer_name="A", segment="S", order_id="1", order_date=D0, sales=Decimal(5)),
        dict(customer_id="a", customer_name="A", segment="S", order_id="1", order_date=D0 + dt.timedelta(2), sales=None),
        dict(customer_id="b", customer_name="B", segment="S", order_id="2", order_date=D0 + dt.timedelta(9), sales=None),
        dict(customer_id=None, customer_name="B", segment="S", order_id="3", order_date=D0 + dt.timedelta(30), sales=Decimal(1)),
    ]
    got = {r.customer_id: (r.recency, r.frequency, r.monetary) for r in rfm.rfm_base(warehouse(*rows)).collect()}
    assert got == {"a": (28, 1, 5), "b": (21, 1, 0)}  # the newest date counts although its row has no customer


@pytest.mark.parametrize(
    "r, f, m, segment",
    [
        (4, 4, 1, rfm.CHAMPIONS), (5, 5, 5, rfm.CHAMPIONS), (3, 4, 3, rfm.LOYAL), (1, 3, 3, rfm.LOYAL),
        (2, 3, 2, rfm.AT_RISK), (2, 2, 5, rfm.LOST), (1, 1, 1, rfm.LOST), (3, 3, 2, rfm.NEW), (5, 3, 2, rfm.NEW),
    ],
)
def test_segments(spark, r, f, m, segment):
    df = spark.createDataFrame([(r, f, m)], "r_score int, f_score int, m_score int")
    assert rfm.rfm_segments(df).first().rfm_segment == segment


def test_scoring_adds_no_join_or_window_to_the_customers(spark):
    """Boundary rows are constants; the plan of the scores is one scan of the written customers."""
    from checks.workspace import workspace

    orders = workspace(spark, SMALL).selected()
    for report in (rfm.rfm(orders), rfm.rfm_financials(rfm.rfm(orders))):
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and "subquery" not in plan
        assert plan.count("Relation [") == 1
