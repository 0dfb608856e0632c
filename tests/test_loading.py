import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_cleaning import write_rows
from tillflow import scratch
from tillflow.operators.loading import align_schema, key_violations, prepare_for_load, summarize_violations, to_warehouse
from tillflow.plans.refresh import load_orders, refresh_warehouse
from tillflow.schema import CLEAN_TYPES, EXPECTED_COLUMNS, WAREHOUSE_SCHEMA
from tillflow.sources import csv_files, versions, warehouse

ENRICHED = dict(zip(EXPECTED_COLUMNS, (
    "1", "QX-2017-000417", "2017-03-14", "2017-03-17", "Standard Class", "OQ-00031", "Ora Quill", "Corporate",
    "Norland", "Eastmere", "Highshire", "90417", "North", "TOY-KI-00000077", "Toys", "Kites",
    "Twin-Line Kite, Blue", "184.50", "3", "0.05", "28.6042", "0.155", "2017", "3", "March", "1",
    "61.50", "5.0", "low", "3", "true", "true",
)))


def text_rows(spark, *changes, columns=EXPECTED_COLUMNS):
    rows = [tuple((ENRICHED | c)[n] for n in columns) for c in changes]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def typed(df):
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in CLEAN_TYPES.items()])


def test_prepared_rows_are_in_order_and_formatted(spark):
    prepared = prepare_for_load(text_rows(spark, {}, columns=tuple(reversed(EXPECTED_COLUMNS))))
    assert tuple(prepared.columns) == EXPECTED_COLUMNS
    row = prepared.first()
    assert (row.order_date, row.ship_date, row.weekend_flag, row.customer_name) == ("2017-03-14", "2017-03-17", True, "Ora Quill")
    assert (row.row_id, row.sales, row.discount_band) == (1, Decimal("184.50"), "low")


def test_prepared_bad_values_are_null(spark):
    bad = {"order_date": "soon", "weekend_flag": "perhaps", "sales": "much", "row_id": "one", "city": None}
    row = prepare_for_load(text_rows(spark, bad)).first()
    assert (row.order_date, row.weekend_flag, row.sales, row.row_id, row.city) == (None,) * 5


def test_missing_and_extra_columns_are_named(spark):
    df = text_rows(spark, {}, columns=tuple(c for c in EXPECTED_COLUMNS if c != "customer_name"))
    with pytest.raises(ValueError, match="^Missing columns: customer_name$"):
        prepare_for_load(df)
    with pytest.raises(ValueError, match="^unexpected columns: color$"):
        align_schema(text_rows(spark, {}).withColumn("color", F.lit("red")))
    with pytest.raises(ValueError, match="Missing columns: city; unexpected columns: town"):
        align_schema(text_rows(spark, {}).withColumnRenamed("city", "town"))


def test_columns_of_another_kind_are_named(spark):
    with pytest.raises(ValueError, match="other types: row_id is string, not bigint, order_date is string, not date"):
        to_warehouse(text_rows(spark, {}))
    typed_rows = typed(text_rows(spark, {}))
    assert align_schema(typed_rows.withColumn("quantity", F.col("quantity").cast("int")), types=True).columns == list(EXPECTED_COLUMNS)
    assert align_schema(typed_rows.withColumn("city", F.lit(None)), types=True).count() == 1


def test_warehouse_types_round_half_up(spark):
    changes = {"sales": "10.005", "profit": "-0.125", "profit_margin": "0.28495", "discount": "0.155"}
    df = to_warehouse(typed(text_rows(spark, changes)))
    assert df.schema == WAREHOUSE_SCHEMA
    row = df.first()
    assert (row.sales, row.profit, row.profit_margin, row.discount) == tuple(
        map(Decimal, ("10.01", "-0.13", "0.2850", "0.16"))
    )


def test_warehouse_overflow_fails(spark):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        to_warehouse(typed(text_rows(spark, {"sales": "99999999999"}))).collect()


def test_key_violations(warehouse):
    df = warehouse(
        {"row_id": 1, "order_id": "a"}, {"row_id": 1, "order_id": "b"}, {"row_id": 2}, {"order_id": "c"}, {"row_id": 3, "order_id": "d"}
    )
    assert sorted(map(str, map(tuple, key_violations(df).collect()))) == [
        "('order_id is null', 2, 1)", "('row_id is null', None, 1)", "('row_id repeats', 1, 2)",
    ]
    assert len(summarize_violations(key_violations(df))) == 3
    assert "1 ids, 2 rows, for instance row_id 1" in summarize_violations(key_violations(df))[2]
    plan = key_violations(df.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(row_id") == 1


def test_load_replaces_and_a_failed_load_leaves_the_table(spark):
    first = typed(text_rows(spark, {"row_id": "1"}, {"row_id": "2"}))
    warehouse.load_warehouse(first, "t_load")
    assert warehouse.scan_warehouse(spark, "t_load").count() == 2
    with pytest.raises(ValueError, match="row_id repeats"):
        warehouse.load_warehouse(typed(text_rows(spark, {}, {}, {})), "t_load")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        warehouse.load_warehouse(typed(text_rows(spark, {"sales": "99999999999"})), "t_load")
    assert warehouse.scan_warehouse(spark, "t_load").count() == 2
    warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "7"})), "t_load")
    assert [r.row_id for r in warehouse.scan_warehouse(spark, "t_load").collect()] == [7]
    assert warehouse.scan_warehouse(spark, "t_load").schema == WAREHOUSE_SCHEMA


def test_rows_without_a_date_survive_the_year_folders(spark):
    warehouse.load_warehouse(typed(text_rows(spark, {"order_date": None, "order_year": None}, {"row_id": "2"})), "t_null_year")
    assert {r.order_year for r in warehouse.scan_warehouse(spark, "t_null_year").collect()} == {None, 2017}


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_processed_round_trip(spark, tmp_path, file_format):
    rows = typed(text_rows(spark, {}, {"row_id": "2", "city": None, "product_name": 'a "b", c', "order_date": None, "order_year": None}))
    path = str(tmp_path / "out")
    if file_format == "csv":
        csv_files.write_processed(rows, path, "csv")
    else:
        csv_files.write_processed(rows, path)
    back = csv_files.read_processed(spark, path, file_format)
    assert back.schema == rows.schema or [f.dataType for f in back.schema] == [f.dataType for f in rows.schema]
    assert sorted(back.collect(), key=lambda r: r.row_id) == sorted(rows.collect(), key=lambda r: r.row_id)


def test_processed_text_as_other_tools_write_it(spark, tmp_path):
    """Whole numbers as floats, capitalised flags, other column order, empty and spelled-out missing values."""
    (tmp_path / "processed.csv").write_text(
        "weekend_flag,order_year,sales,order_date,row_id,discount_band,profit_margin,postal_code\n"
        "True,2016.0,261.96,2016-11-08,1,low,0.16,42420.0\n"
        "False,,,,2,,nan,NaN\n"
    )
    first, second = csv_files.read_processed(spark, str(tmp_path / "processed.csv"), "csv").orderBy("row_id").collect()
    assert tuple(first) == (True, 2016, Decimal("261.96"), dt.date(2016, 11, 8), 1, "low", 0.16, 42420)
    assert tuple(second) == (False, None, None, None, 2, None, None, None)


def test_orders_come_from_the_first_source_there_is(spark, tmp_path):
    raw = write_rows(tmp_path / "raw.csv", [{"Row ID": "5"}])
    processed, absent = str(tmp_path / "processed"), str(tmp_path / "absent.csv")
    with pytest.raises(FileNotFoundError):
        load_orders(spark, "t_absent", processed, [absent])
    assert load_orders(spark, raw=[absent, raw]).first().row_id == 5
    made = load_orders(spark, "t_absent", processed, [absent, raw])
    assert made.first().row_id == 5 and (tmp_path / "processed").is_dir()
    assert load_orders(spark, "t_absent", processed).first().row_id == 5
    warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "9"})), "t_source")
    assert load_orders(spark, "t_source", processed).first().row_id == 9


def test_warehouse_refresh_reports(spark, tmp_path):
    raw = write_rows(tmp_path / "raw.csv", [{"Row ID": "1"}, {"Row ID": "2"}, {"Row ID": "3", "Sales": "x"}])
    report = refresh_warehouse(spark, raw, "t_refresh").first()
    assert (report.source_rows, report.duplicate_rows, report.invalid_sales) == (3, 1, 1)
    assert warehouse.scan_warehouse(spark, "t_refresh").count() == 2
    assert warehouse.table_stats(warehouse.scan_warehouse(spark, "t_refresh")).first() == (2, 1, 1)


def test_database_options():
    assert warehouse.jdbc_write_options("jdbc:x") == {
        "url": "jdbc:x", "dbtable": "retail_orders", "truncate": "true", "batchsize": "1000",
    }
    options = warehouse.jdbc_read_options("jdbc:x", 1, 10_000, 8)
    assert options["partitionColumn"] == "row_id" and options["numPartitions"] == "8"


def test_year_bounds_skip_loads(spark, tmp_path):
    from tillflow.operators.filters import Selection, select_orders

    rows = typed(text_rows(spark, *[{"row_id": str(y), "order_date": f"{y}-05-01", "order_year": str(y)} for y in range(2010, 2020)]))
    warehouse.load_warehouse(rows, "t_years")
    orders = warehouse.scan_warehouse(spark, "t_years")
    picked = select_orders(orders, Selection(regions=("North",), start=dt.date(2012, 5, 1), end=dt.date(2014, 4, 30)))
    assert sorted(r.order_year for r in picked.collect()) == [2012, 2013]
    plan = picked.select("sales")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan or "isnotnull(order_year" in plan.split("PartitionFilters")[1] and "In(region" not in plan.split("PartitionFilters")[0]
    assert "PushedFilters: [" in plan and "region" in plan.split("PushedFilters")[1]
    assert "product_name" not in plan.split("ReadSchema")[1]


def test_features_are_derived_after_the_shuffle(spark):
    from tillflow.operators.features import engineer_features

    cleaned = typed(text_rows(spark, {"order_date": "2017-05-01"}, {"row_id": "2", "order_date": None}))
    base = cleaned.drop("order_year", "order_month", "order_month_name", "order_quarter", "weekend_flag", "shipping_days")
    warehouse.load_warehouse(base, "t_derived", before_write=engineer_features)
    rows = warehouse.scan_warehouse(spark, "t_derived").orderBy("row_id").collect()
    assert sorted((r.order_year or 0, r.order_month_name or "") for r in rows) == [(0, ""), (2017, "May")]


def test_refresh_moves_only_rows_that_may_have_copies(spark, tmp_path, monkeypatch):
    """Whole rows pass no shuffle on their way from the raw file to the table."""
    from tillflow.plans import refresh

    seen, load = [], refresh.load_warehouse
    monkeypatch.setattr(refresh, "load_warehouse", lambda rows, *a, **k: (seen.append((rows, k)), load(rows, *a, **k)))
    refresh_warehouse(spark, write_rows(tmp_path / "raw.csv", [{"Row ID": "1"}, {"Row ID": "2"}, {"Row ID": "3", "Sales": "7"}]), "t_moves")
    rows, options = seen[0]
    union = rows._jdf.queryExecution().executedPlan().toString().split("Union", 1)[1]
    assert options["in_place"] and union.index("FileScan csv") < union.index("fun=min" if "fun=min" in union else "min(row_id")
    assert warehouse.scan_warehouse(spark, "t_moves").count() == 2


def test_lines_with_their_order_pass_no_shuffle(spark, conf, monkeypatch):
    """On their way from the joins to the table, where no side of a join is broadcast."""
    from checks import workspace
    from tests.conftest import SMALL

    conf(spark__sql__autoBroadcastJoinThreshold=-1)
    seen = []
    monkeypatch.setattr(workspace, "load_warehouse", lambda rows, *a, **k: seen.append((rows, k)))
    workspace.Workspace(spark, SMALL).table
    rows, options = seen[0]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = rows._jdf.queryExecution().explainString(mode)
    moved = [part.split("Input", 1)[1].split("\n")[0] for part in plan.split("\n(") if ") Exchange\n" in part]
    lines = [columns for columns in moved if "l_partkey" in columns]
    assert len(lines) == 1 and "c_name" not in "".join(c for c in moved if "row_id" in c or "l_orderkey" in c), moved
    assert options["in_place"]


def loads(spark, table):
    base = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")) / f"{table}.versions" / "data"
    return sorted(p.name for p in base.iterdir()) if base.exists() else []


def test_old_versions_go_later_and_discard_does_not_touch_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path / "shared"))
    raw = write_rows(tmp_path / "raw.csv", [{"Row ID": "1"}, {"Row ID": "2", "City": "Westmere"}])
    for _ in range(3):
        refresh_warehouse(spark, raw, "t_copies")
    assert len(loads(spark, "t_copies")) == 3  # replaced less than a day ago
    base = warehouse._base(spark, "t_copies")
    stray = versions.load_folder(base, "vstray")
    spark.range(1).write.parquet(stray)
    assert len(versions.vacuum(spark, base, keep_versions=2, keep_hours=0)) == 2  # the oldest load and the stray one
    assert len(loads(spark, "t_copies")) == 2 and [v.number for v in versions.versions(spark, base)] == [2, 3]
    kept = scratch.settle(spark.range(3), "kept")
    assert kept.count() == 3
    scratch.discard(spark)
    assert not list((tmp_path / "shared").glob("*/*"))
    assert warehouse.scan_warehouse(spark, "t_copies").count() == 2
    warehouse.drop_warehouse(spark, "t_copies")
    assert loads(spark, "t_copies") == [] and not spark.catalog.tableExists("t_copies")


def test_a_query_goes_on_over_a_load(spark):
    """A report that was planned before a load finishes after it, with the old rows."""
    warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "1"}, {"row_id": "2"})), "t_reader")
    before = warehouse.scan_warehouse(spark, "t_reader").select("row_id")
    before._jdf.queryExecution().executedPlan()
    warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "7"})), "t_reader")
    warehouse.append_warehouse(typed(text_rows(spark, {"row_id": "8"})), "t_reader")
    assert sorted(r.row_id for r in before.collect()) == [1, 2]
    assert sorted(r.row_id for r in warehouse.scan_warehouse(spark, "t_reader").collect()) == [7, 8]


def test_another_session_finds_the_table(spark, tmp_path):
    """A catalog without the table, and one whose view is behind."""
    path = str(tmp_path / "table")
    warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "1"}, {"row_id": "2"})), "t_shared", path)
    spark.sql("DROP VIEW t_shared")
    assert not warehouse.open_warehouse(spark, "t_shared")  # not in its usual place
    assert warehouse.scan_warehouse(spark, "t_shared", path).count() == 2
    # Another session's load is an entry of the log that this catalog knows nothing of.
    load = versions.new_load()
    warehouse._write(to_warehouse(typed(text_rows(spark, {"row_id": "3"}))), versions.load_folder(path, load))
    assert versions.commit(spark, path, versions.current(spark, path), (load,)).number == 2
    assert warehouse.scan_warehouse(spark, "t_shared").count() == 1
    warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "4"})), "t_shared", keep_versions=1, keep_hours=0)
    assert [v.number for v in versions.versions(spark, path)] == [3] and len(list((tmp_path / "table" / "data").iterdir())) == 1


def test_writers_at_the_same_time(spark, monkeypatch):
    """An append whose version number another writer takes first follows that writer's version."""
    warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "1"})), "t_race")
    point, raced = warehouse._point, []

    def slow(session, table, base, *more):
        if not raced:
            raced.append(True)
            other = versions.new_load()
            warehouse._write(to_warehouse(typed(text_rows(spark, {"row_id": "2"}))), versions.load_folder(base, other))
            now = versions.current(spark, base)
            assert versions.commit(spark, base, now, (*now.loads, other))
        point(session, table, base, *more)

    monkeypatch.setattr(warehouse, "_point", slow)
    warehouse.append_warehouse(typed(text_rows(spark, {"row_id": "3"})), "t_race")
    monkeypatch.undo()
    assert sorted(r.row_id for r in warehouse.scan_warehouse(spark, "t_race").collect()) == [1, 2, 3]
    raced.clear()
    monkeypatch.setattr(warehouse, "_point", slow)
    with pytest.raises(ValueError, match="row_id repeats"):  # the other writer's row has the same id
        warehouse.append_warehouse(typed(text_rows(spark, {"row_id": "2"})), "t_race")


def test_a_cut_off_log_entry_is_passed_over(spark, tmp_path):
    path = tmp_path / "table"
    warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "1"})), "t_cut", str(path))
    (path / "_log" / "000000000002.json").write_text('{"loads": ["v')
    assert warehouse.scan_warehouse(spark, "t_cut").count() == 1


def test_batches_are_appended_once(spark):
    for batch, rows in ((0, {"row_id": "1"}), (0, {"row_id": "1"}), (1, {"row_id": "2"}), (0, {"row_id": "1"})):
        warehouse.append_warehouse(typed(text_rows(spark, rows)), "t_batches", batch=("daily", batch))
    assert sorted(r.row_id for r in warehouse.scan_warehouse(spark, "t_batches").collect()) == [1, 2]
    assert len(loads(spark, "t_batches")) == 2


def test_a_failed_switch_leaves_the_old_table(spark, monkeypatch):
    rows = typed(text_rows(spark, {"row_id": "1"}, {"row_id": "2"}))
    warehouse.load_warehouse(rows, "t_switch")
    before = loads(spark, "t_switch")
    run = type(spark).sql

    def broken(self, text, *args, **named):
        if text.startswith("CREATE OR REPLACE VIEW"):
            raise RuntimeError("no catalog")
        return run(self, text, *args, **named)

    monkeypatch.setattr(type(spark), "sql", broken)
    with pytest.raises(RuntimeError, match="no catalog"):
        warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "7"})), "t_switch")
    monkeypatch.undo()
    assert loads(spark, "t_switch") == before
    assert warehouse.scan_warehouse(spark, "t_switch").count() == 2


def test_processed_files_and_table_in_one_call(spark, tmp_path):
    raw = write_rows(tmp_path / "raw.csv", [{"Row ID": "1"}, {"Row ID": "2"}, {"Row ID": "3", "Quantity": "0", "Order Date": "14.3.2017"}])
    report = refresh_warehouse(spark, raw, "t_both", str(tmp_path / "table"), str(tmp_path / "out"), date_format="M/d/yyyy").first()
    assert (report.source_rows, report.rows_after_cleaning, report.invalid_quantity, report.missing_values["order_date"]) == (3, 2, 1, 1)
    assert csv_files.read_processed(spark, str(tmp_path / "out")).count() == 2
    assert warehouse.scan_warehouse(spark, "t_both").count() == 2 and len(list((tmp_path / "table" / "data").iterdir())) == 1


def test_processed_text_is_loaded(spark, tmp_path):
    path = str(tmp_path / "processed")
    csv_files.write_csv(text_rows(spark, {"row_id": "4"}, {"row_id": "5", "sales": "much"}), path)
    warehouse.load_processed(spark, path, "t_text")
    found = warehouse.scan_warehouse(spark, "t_text").orderBy("row_id").collect()
    assert [(r.row_id, r.sales, r.order_date) for r in found] == [
        (4, Decimal("184.50"), dt.date(2017, 3, 14)), (5, None, dt.date(2017, 3, 14)),
    ]


def test_views_show_what_the_table_holds_now(spark):
    from tillflow.plans import views

    warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "1"})), "t_live")
    names = views.register_views(spark, "t_live")
    total = "SELECT sum(total_sales) FROM"
    assert spark.sql(f"{total} vw_region_performance").first()[0] == Decimal("184.50")
    with pytest.raises(ValueError, match="row_id repeats"):
        warehouse.append_warehouse(typed(text_rows(spark, {"row_id": "1"})), "t_live")
    warehouse.append_warehouse(typed(text_rows(spark, {"row_id": "2"}, {"row_id": "3"})), "t_live")
    views_with_sales = [n for n in names if n != "vw_sales_summary"]
    assert {n: spark.sql(f"{total} {n}").first()[0] for n in views_with_sales} == dict.fromkeys(views_with_sales, Decimal("553.50"))
    assert spark.sql("SELECT count(*), max(total_sales_all_rows) FROM vw_sales_summary").first() == (3, Decimal("553.50"))
    warehouse.load_warehouse(typed(text_rows(spark, {"row_id": "1"}, {"row_id": "2"})), "t_live")  # a load shows, too
    assert {n: spark.sql(f"{total} {n}").first()[0] for n in views_with_sales} == dict.fromkeys(views_with_sales, Decimal("369.00"))


def test_a_week_reads_part_of_a_year(spark, conf):
    """Files are in date order, so pages and row groups outside of a date range are skipped."""
    from tillflow.operators.filters import Selection, select_orders

    days = spark.range(120_000).selectExpr("id AS n", "date_add(DATE'2015-01-01', int(id * 7919 % 365)) AS d")
    one = typed(text_rows(spark, {})).drop("row_id", "order_date")
    warehouse.load_warehouse(
        days.crossJoin(one).withColumns({"row_id": F.col("n"), "order_date": F.col("d"), "order_year": F.lit(2015)}).select(*EXPECTED_COLUMNS),
        "t_week",
    )
    week = select_orders(warehouse.scan_warehouse(spark, "t_week"), Selection(start=dt.date(2015, 6, 1), end=dt.date(2015, 6, 7)))
    picked = week.select("order_date", "sales")
    execution = picked._jdf.queryExecution()
    rows = execution.executedPlan().execute().count()
    scan = execution.executedPlan().collectLeaves().head()
    read = scan.metrics().apply("numOutputRows").value()
    assert rows == week.count() > 2000 and read < 120_000 / 2


def test_named_database_comes_first(spark, monkeypatch):
    from tillflow.plans import refresh as plans

    seen = {}
    monkeypatch.setattr(plans, "scan_jdbc", lambda _, options: seen.update(options) or "rows")
    assert load_orders(spark, "t_any", database=warehouse.jdbc_read_options("jdbc:x", 1, 9, 2)) == "rows"
    assert seen["url"] == "jdbc:x" and seen["numPartitions"] == "2"
    assert warehouse.jdbc_swap_statements("t")[1] == "INSERT INTO t SELECT * FROM t_staging"


def test_salvage_fills_up_short_lines_and_sets_long_ones_aside(spark, tmp_path):
    path = write_rows(tmp_path / "raw.csv", [{"Row ID": str(i)} for i in range(1, 7)])
    lines = Path(path).read_text(encoding="latin-1").splitlines()
    lines[2] = lines[2].rsplit(",", 2)[0]  # lacks two fields
    lines[3] += ",more"
    lines[4] = "5"
    lines[5] += ","  # one more field, if an empty one
    lines.append(lines[6].replace('"Twin', '"Twin "" (').rsplit(",", 1)[0])
    lines.append('8,"open')
    Path(path).write_text("\n".join(lines) + "\n", encoding="latin-1")
    made = csv_files.salvage_raw(spark, path)
    assert made.counts == {"lines_read": 8, "lines_padded": 3, "lines_rejected": 3}
    found = sorted((r["Row ID"], r["Discount"], r["Profit"], r["Order ID"]) for r in made.lines.select("Row ID", "Discount", "Profit", "Order ID").fillna("-").collect())
    order = "QX-2017-000417"
    assert found == [
        ("1", "0.05", "28.6042", order), ("2", "-", "-", order), ("5", "-", "-", "-"), ("6", "0.05", "-", order), ("6", "0.05", "28.6042", order),
    ]
    assert made.lines.columns == lines[0].split(",")
    assert sorted(r.line for r in made.rejected.collect()) == sorted([lines[3], lines[5], lines[8]])
    assert all(r.file.endswith("raw.csv") for r in made.rejected.collect())


def test_refresh_with_salvage(spark, tmp_path):
    path = write_rows(tmp_path / "raw.csv", [{"Row ID": "1"}, {"Row ID": "2", "City": "Westmere"}])
    with open(path, "a", encoding="latin-1") as file:
        file.write("3,QX-9\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        refresh_warehouse(spark, path, "t_salvage")
    report = refresh_warehouse(spark, path, "t_salvage", malformed="salvage").first()
    assert (report.source_rows, report.missing_values["sales"]) == (3, 1)
    assert sorted(r.row_id for r in warehouse.scan_warehouse(spark, "t_salvage").collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="fail or salvage"):
        refresh_warehouse(spark, path, "t_salvage", malformed="skip")
