import csv
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from checks.workspace import Workspace
from tests.conftest import MEDIUM, ORDER_LINE, SMALL
from tillflow.functions import normalize_header, null_if_token, parse_number, strip
from tillflow.operators import cleaning
from tillflow.operators.features import engineer_features
from tillflow.plans.refresh import refresh
from tillflow.schema import NA_TOKENS
from tillflow.sources.csv_files import malformed_lines, read_raw


def write_rows(path, rows, encoding="latin-1"):
    with open(path, "w", newline="", encoding=encoding) as file:
        writer = csv.DictWriter(file, list(ORDER_LINE))
        writer.writeheader()
        writer.writerows(ORDER_LINE | r for r in rows)
    return str(path)


def test_two_copies_become_one_clean_row(spark, tmp_path):
    path = write_rows(tmp_path / "raw.csv", [{"Row ID": "1"}, {"Row ID": "2"}])
    cleaned, report = cleaning.clean_with_report(read_raw(spark, path))
    (row,) = cleaned.collect()
    assert row.row_id == 1 and row.shipping_days == 3 and row.order_month_name == "March"
    assert row.weekend_flag is False and 0 <= row.profit_margin <= 1
    assert isinstance(cleaned.schema["sales"].dataType, T.DecimalType) and row.profit == Decimal("28.6042")
    report = report.first()
    assert (report.source_rows, report.rows_after_cleaning, report.duplicate_rows) == (2, 1, 1)
    assert report.missing_percent == {} and set(report.missing_values.values()) == {0}


@pytest.mark.parametrize(
    "folder, expected",
    [
        (SMALL, (6120, 6000, 120, [47, 45, 43, 115, 43], 173, 55, 53, 92)),
        (MEDIUM, (61200, 60000, 1200, [472, 458, 437, 1144, 431], 1721, 550, 530, 927)),
    ],
)
def test_report_on_planted_defects(spark, folder, expected):
    report = cleaning.clean_with_report(Workspace(spark, folder).raw)[1].first()
    missing = [report.missing_values[c] for c in ("order_date", "ship_date", "region", "sales", "profit")]
    assert (
        report.source_rows, report.rows_after_cleaning, report.duplicate_rows, missing,
        report.invalid_sales, report.invalid_quantity, report.invalid_discount, report.invalid_dates,
    ) == expected
    assert report.missing_percent["sales"] == round(expected[3][3] / expected[1] * 100, 2)


def test_csv_quotes_encoding_and_spaces(spark, tmp_path):
    name = 'Desk "Pro", 5\' caf\xe9\xa0'
    path = write_rows(tmp_path / "raw.csv", [{"Product Name": name, "Customer ID": " C-1 "}])
    row = cleaning.clean(read_raw(spark, path)).first()
    assert row.product_name == 'Desk "Pro", 5\' caf\xe9'
    assert row.customer_id == " C-1 "  # identifiers are not trimmed


def test_line_break_inside_quotes(spark, tmp_path):
    path = write_rows(tmp_path / "raw.csv", [{"Product Name": "two\nlines"}])
    assert cleaning.clean(read_raw(spark, path, multi_line=True)).first().product_name == "two\nlines"


def test_line_break_inside_quotes_through_refresh(spark, tmp_path):
    path = write_rows(tmp_path / "raw.csv", [{"Product Name": "two\nlines"}, {"Row ID": "2"}])
    rows, report = refresh(spark, path, str(tmp_path / "out"), multi_line=True)
    assert {r.product_name for r in rows.collect()} == {"two\nlines", ORDER_LINE["Product Name"]}
    assert report.first().source_rows == 2
    # Without the option the two halves are lines with too few fields.
    with pytest.raises(Exception, match="(?i)malformed"):
        cleaning.clean(read_raw(spark, path)).collect()
    assert malformed_lines(spark, path).count() == 2


def test_lines_with_other_numbers_of_fields_are_not_cut(spark, tmp_path):
    path = write_rows(tmp_path / "raw.csv", [{}, {"Row ID": "2"}])
    with open(path, "a", encoding="latin-1") as file:
        file.write(",".join(["3", *["x"] * 20, "EXTRA"]) + "\r\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        cleaning.clean(read_raw(spark, path)).select("row_id").collect()
    (line,) = malformed_lines(spark, path).collect()
    assert line.line.endswith("EXTRA") and line.file.endswith("raw.csv")


def test_files_with_other_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    write_rows(folder / "a.csv", [{}])
    swapped = list(ORDER_LINE)
    i, j = swapped.index("Sales"), swapped.index("Quantity")
    swapped[i], swapped[j] = swapped[j], swapped[i]
    with open(folder / "b.csv", "w", newline="", encoding="latin-1") as file:
        writer = csv.DictWriter(file, swapped)
        writer.writeheader()
        writer.writerow(ORDER_LINE)
    with pytest.raises(Exception, match="CSV header does not conform"):
        cleaning.clean(read_raw(spark, str(folder))).collect()


def test_fractions_and_long_numbers_are_kept(raw):
    (row,) = cleaning.clean(raw({"Sales": "123456789012345678", "Quantity": "1.5"})).collect()
    assert row.sales == 123456789012345678 and row.quantity == Decimal("1.5")
    enriched = engineer_features(cleaning.clean(raw({"Sales": "10", "Quantity": "1.5"})))
    assert round(enriched.first().revenue_per_unit, 2) == 6.67


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_raw(spark, str(tmp_path / "absent.csv"))


def test_headers():
    assert [normalize_header(h) for h in (" Row ID", "Sub-Category ", "Sales")] == ["row_id", "sub_category", "sales"]


def test_null_tokens(spark):
    values = [*NA_TOKENS, "na", " NA", "0", "nothing"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(null_if_token(F.col("v"))).collect()] == [None] * 19 + ["na", " NA", "0", "nothing"]


@pytest.mark.parametrize(
    "text, number",
    [
        ("1", 1), ("1,000", None), ("$5", None), (" 7 ", 7), ("1e3", 1000), ("nan", None), ("inf", None), ("1d", None),
        ("", None), ("abc", None), ("-2.5", Decimal("-2.5")), (".5", Decimal("0.5")), ("3.", 3), ("1" * 30, None),
    ],
)
def test_number_text(spark, text, number):
    df = spark.createDataFrame([(text,)], "v string")
    row = df.select(parse_number(F.col("v"), T.DecimalType(18, 4)), parse_number(F.col("v"), T.DoubleType())).first()
    assert row[0] == number and row[1] == (float(text) if len(text) == 30 else number)


def test_integer_text(spark):
    df = spark.createDataFrame([("2.0",), ("3",), ("x",)], "v string")
    assert [r[0] for r in df.select(parse_number(F.col("v"), T.LongType())).collect()] == [2, 3, None]


def test_strip_takes_unicode_space_and_keeps_blank(spark):
    texts = ["\xa0 a b \t", "   ", None, "\u3000\x1cx\u2028", "caf\xe9"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r[0] for r in df.select(strip(F.col("v"))).collect()] == [t if t is None else t.strip() for t in texts]


def test_dates(raw):
    rows = cleaning.clean(
        raw({"Order Date": "13/45/1999"}, {"Order Date": "2/29/2015"}, {"Order Date": "1/2/2016"}, {"Order Date": "x"})
    ).collect()
    assert sorted(str(r.order_date) for r in rows) == ["2016-01-02", "None"]  # the three unreadable ones are copies
    assert {r.shipping_days for r in rows if r.order_date is None} == {None}


def test_nulls_equal_in_copies_and_smallest_id_stays(raw):
    rows = cleaning.clean(raw({"Row ID": "10", "City": "NA"}, {"Row ID": "9", "City": ""}, {"Row ID": "3"})).collect()
    assert sorted(r.row_id for r in rows) == [3, 9]


def test_copies_that_differ_in_edge_spaces_are_copies(raw):
    assert cleaning.clean(raw({"City": "Troy "}, {"City": " Troy"})).count() == 1


def test_invalid_rows_are_counted_and_kept(raw):
    source = raw({"Sales": "-1"}, {"Sales": "x"}, {"Quantity": "0"}, {"Discount": "1.2"}, {"Discount": "-0.1"}, {"Ship Date": ""})
    cleaned, report = cleaning.clean_with_report(source)
    report = report.first()
    assert cleaned.count() == 6
    assert (report.invalid_sales, report.invalid_quantity, report.invalid_discount, report.invalid_dates) == (2, 1, 2, 1)


def test_absent_columns_count_as_valid_and_add_nothing(spark):
    source = spark.createDataFrame([("1", "x"), ("2", "x")], "`Row ID` string, `City` string")
    cleaned, report = cleaning.clean_with_report(source)
    report = report.first()
    assert cleaned.columns == ["row_id", "city"] and report.duplicate_rows == 1
    assert (report.invalid_sales, report.invalid_quantity, report.invalid_discount, report.invalid_dates) == (0, 0, 0, 0)


def test_without_row_id(spark):
    source = spark.createDataFrame([("x",), ("x",), ("y",)], "`City` string")
    assert sorted(r.city for r in cleaning.clean(source).collect()) == ["x", "y"]


def test_empty_input(raw, spark):
    source = raw({}).limit(0)
    report = cleaning.clean_with_report(source)[1].first()
    assert (report.source_rows, report.rows_after_cleaning, report.duplicate_rows, report.missing_percent) == (0, 0, 0, {})


def test_missing_by_column(raw):
    folded = cleaning.fold_copies(cleaning.standardize(raw({"City": "NA"}, {}, {"Sales": "1"})))
    rows = {r.column_name: (r.missing, r.missing_percent) for r in cleaning.missing_by_column(cleaning.quality_report(folded)).collect()}
    assert rows["city"] == (1, 33.33) and rows["sales"] == (0, None) and len(rows) == 21


def test_hot_group_of_copies(spark):
    """A third of all rows are copies of one row; pre-aggregation leaves one row per map task."""
    df = spark.range(30_000, numPartitions=8).selectExpr("id AS row_id", "if(id % 3 = 0, 'hot', string(id)) AS city")
    rows = {r.city: (r.row_id, r._copies) for r in cleaning.fold_copies(df).where("_copies > 1").collect()}
    assert rows == {"hot": (0, 10_000)}


def test_refresh_lazy_and_written_agree(spark, tmp_path):
    path = write_rows(tmp_path / "raw.csv", [{"Row ID": "1"}, {"Row ID": "2"}, {"Row ID": "3", "Sales": "0"}])
    lazy, lazy_report = refresh(spark, path)
    written, written_report = refresh(spark, path, str(tmp_path / "deep" / "out"))
    assert sorted(lazy.collect()) == sorted(written.collect())
    assert lazy_report.first() == written_report.first()
    assert (tmp_path / "deep" / "out" / "order_year=2017").is_dir()


def test_trimming_whatever_stands_at_the_ends(spark):
    """One look at a row tells whether a value has to be trimmed by the set of white space characters."""
    values = ["a", "", " a ", "a\n", "\na", "a\r\n", " a", "a ", "\u0085", "é", "日本", "a b", "~", "!", "　é　", "x\x00", None, "a​"]
    rows = [(v, w) for v in values for w in ("x", values[len(v or "") % 5], None)]
    df = cleaning.trim_text(spark.createDataFrame(rows, "region string, segment string"))
    strip = lambda v: v and v.strip()
    assert [tuple(r) for r in df.collect()] == [(strip(a), strip(b)) for a, b in rows]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("CASE WHEN") == 2
