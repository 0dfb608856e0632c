from tests.test_cleaning import write_rows
from tillflow.plans.refresh import refresh_warehouse
from tillflow.sources import versions, warehouse
from tillflow.streaming.arrivals import append_arrivals

LINES = [{"Row ID": str(i), "City": f"Town {i}", "Quantity": str(1 + i % 3)} for i in range(1, 7)]


def content(spark, table):
    return sorted(tuple(r)[1:] for r in warehouse.scan_warehouse(spark, table).collect())


def test_two_deliveries_with_an_overlap_equal_one(spark, conf, tmp_path):
    conf(spark__sql__shuffle__partitions=2)
    folder, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    folder.mkdir()
    write_rows(folder / "a.csv", [*LINES[:4], LINES[0] | {"Row ID": "90"}])  # a copy in the same file, too
    append_arrivals(spark, str(folder), checkpoint, "t_arrived").awaitTermination()
    assert len(content(spark, "t_arrived")) == 4
    write_rows(folder / "b.csv", [line | {"Row ID": str(100 + i)} for i, line in enumerate(LINES[2:])])
    append_arrivals(spark, str(folder), checkpoint, "t_arrived").awaitTermination()
    refresh_warehouse(spark, write_rows(tmp_path / "whole.csv", LINES), "t_whole")
    assert content(spark, "t_arrived") == content(spark, "t_whole")
    # Started again without new files, nothing is added.
    base, before = warehouse._base(spark, "t_arrived"), content(spark, "t_arrived")
    made = versions.current(spark, base)
    append_arrivals(spark, str(folder), checkpoint, "t_arrived").awaitTermination()
    assert versions.current(spark, base) == made and content(spark, "t_arrived") == before


def test_a_batch_that_runs_again_is_added_once(spark, conf, tmp_path):
    """The stream's own record of its last batch is lost after the append, as when a driver ends in between."""
    conf(spark__sql__shuffle__partitions=2)
    folder, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    folder.mkdir()
    write_rows(folder / "a.csv", LINES)
    append_arrivals(spark, str(folder), str(checkpoint), "t_again").awaitTermination()
    for mark in (checkpoint / "commits").iterdir():
        mark.unlink()
    append_arrivals(spark, str(folder), str(checkpoint), "t_again").awaitTermination()
    assert len(content(spark, "t_again")) == 6
