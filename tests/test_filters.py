import datetime as dt

from tillflow.operators.filters import Selection, date_bounds, filter_options, is_empty, select_orders

DAY = dt.date(2020, 5, 1)


def rows(warehouse):
    full = {"region": "R", "segment": "S", "category": "C", "order_date": DAY, "order_year": 2020}
    changes = [{}, {"region": None}, {"segment": None}, {"category": None}, {"order_date": None, "order_year": None},
               {"region": "Q", "order_date": dt.date(2021, 1, 1), "order_year": 2021}]
    return warehouse(*[{"row_id": i} | full | c for i, c in enumerate(changes)])


def ids(df):
    return sorted(r.row_id for r in df.collect())


def test_all_options_still_drop_rows_without_a_value(warehouse):
    assert ids(select_orders(rows(warehouse))) == [0, 5]


def test_members_and_inclusive_dates(warehouse):
    df = rows(warehouse)
    assert ids(select_orders(df, Selection(regions=("Q", "Z")))) == [5]
    assert ids(select_orders(df, Selection(start=DAY, end=DAY))) == [0]
    assert ids(select_orders(df, Selection(start=dt.date(2020, 5, 2)))) == [5]
    assert ids(select_orders(df, Selection(regions=()))) == []


def test_options_and_bounds(warehouse):
    df = rows(warehouse)
    assert sorted(map(tuple, filter_options(df).collect())) == [
        ("category", "C"), ("region", "Q"), ("region", "R"), ("segment", "S"),
    ]
    assert tuple(date_bounds(df).first()) == (DAY, dt.date(2021, 1, 1))


def test_is_empty(warehouse):
    df = rows(warehouse)
    assert is_empty(select_orders(df, Selection(segments=("none",)))).first()[0] is True
    assert is_empty(select_orders(df)).first()[0] is False
