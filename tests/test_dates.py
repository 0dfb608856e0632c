import pytest

from tests.test_cleaning import write_rows
from tillflow.operators import dates
from tillflow.plans.refresh import refresh

TEXTS = "f string, order_date string, ship_date string"


def test_formats_of_each_file(spark):
    df = spark.createDataFrame([
        ("a", "1/2/2017", "1/25/2017"), ("a", "1/25/2017", None), ("b", "25.12.2016", "x"), ("b", None, None),
        ("c", "2017-1-2", "2017-05-06"), (None, "31-12-2017", "1-1-2017"), (None, "1-1-2017", "5-31-2017"),
    ], TEXTS)
    found = {(r.f, r.column_name): (r.format, r.parsed, r.filled, r.tied) for r in dates.date_formats(df, by=["f"]).collect()}
    assert found == {
        ("a", "order_date"): ("M/d/yyyy", 2, 2, None), ("a", "ship_date"): ("M/d/yyyy", 1, 1, None),
        ("b", "order_date"): ("d.M.yyyy", 1, 1, None), ("b", "ship_date"): (None, 0, 1, None),
        ("c", "order_date"): ("yyyy-M-d", 1, 1, None), ("c", "ship_date"): ("yyyy-M-d", 1, 1, None),
        (None, "order_date"): ("d-M-yyyy", 2, 2, None), (None, "ship_date"): ("M-d-yyyy", 2, 2, None),
    }
    parsed = dates.parse_mixed_dates(df, by=["f"])
    assert parsed.columns == df.columns
    assert [str(r.order_date) for r in parsed.where("f IS NULL").orderBy("order_date").collect()] == ["2017-01-01", "2017-12-31"]
    assert [str(r.order_date) for r in parsed.where("f = 'a'").orderBy("order_date").collect()] == ["2017-01-02", "2017-01-25"]


def test_a_tie_is_an_error_that_names_the_formats(spark):
    df = spark.createDataFrame([("a", "1/2/2017", "3/25/2017")], TEXTS)
    with pytest.raises(ValueError, match="order_date read as well as M/d/yyyy or d/M/yyyy"):
        dates.parse_mixed_dates(df, by=["f"])
    assert dates.infer_date_format(df) == "M/d/yyyy"  # both columns together are no tie
    same = spark.createDataFrame([("a", "1/1/2017", "2/2/2017")], TEXTS)
    assert dates.infer_date_format(same) == "M/d/yyyy"  # the same dates in either
    with pytest.raises(ValueError, match="No date"):
        dates.infer_date_format(spark.createDataFrame([("a", "soon", None)], TEXTS))
    row = dates.parse_mixed_dates(spark.createDataFrame([("a", "14.3.2017", None)], TEXTS)).first()
    assert (str(row.order_date), row.ship_date) == ("2017-03-14", None)


def test_refresh_finds_the_format(spark, tmp_path):
    changes = [{"Order Date": "14.3.2017", "Ship Date": "17.3.2017"}, {"Row ID": "2", "Order Date": "1.2.2017", "Ship Date": "3.2.2017"}]
    path = write_rows(tmp_path / "raw.csv", changes)
    rows = refresh(spark, path, date_format=None)[0].orderBy("row_id").collect()
    assert [(str(r.order_date), r.shipping_days) for r in rows] == [("2017-03-14", 3), ("2017-02-01", 2)]


def test_each_text_is_read_once_however_often_it_occurs(spark):
    """Texts are counted before they are parsed, and the formats are not found again when rows are read."""
    rows = spark.range(100).selectExpr("'a' AS f", "'1/25/2017' AS order_date", "'1/31/2017' AS ship_date")
    plan = dates.date_formats(rows, by=["f"])._jdf.queryExecution().executedPlan().toString().splitlines()
    assert "_text#" in next(text for text in reversed(plan) if "HashAggregate" in text).split("functions=")[0]
    parsed = dates.parse_mixed_dates(rows, by=["f"])
    assert parsed._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert parsed.where("order_date IS NOT NULL").count() == 100
