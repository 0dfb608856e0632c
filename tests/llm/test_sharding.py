import random
from zlib import crc32

from pyspark.sql import functions as F

from tests.llm.conftest import DOCUMENT, ODD_ROWS, rows
from tillflow.llm import sharding


def groups_in_order(docs):
    value = F.coalesce("text", F.lit(""))
    return [r["n"] for r in docs.groupBy(F.xxhash64(value).alias("h"), F.crc32(value).alias("c"))
            .agg(F.sum(F.octet_length(value) + 1).alias("n")).orderBy("h", "c").collect()]


def smallest_capacity(sizes, shards):
    def needed(capacity):
        used, load = 1, 0
        for s in sizes:
            if load + s > capacity:
                used, load = used + 1, 0
            load += s
        return used

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


def check(docs, shards=8):
    found = [r.asDict() for r in sharding.assign_shards(docs, shards=shards).collect()]
    texts = docs.select("doc_id", "text").collect()
    key = lambda x: (str(x[0]), x[1], x[2])
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=key) == sorted(
        ((r.doc_id, len((r.text or "").encode()) + 1, crc32((r.text or "").encode())) for r in texts), key=key
    )
    loads, slots = {}, {}
    for r in found:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert max(loads.values()) == smallest_capacity(groups_in_order(docs), shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shard_of = {}
    for r in found:
        assert shard_of.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    return found


def test_corpus(table):
    check(table("documents", "sf0.01"))


def test_odd_rows_and_more_shards_than_groups(odd):
    check(odd)
    check(odd, shards=40)


def test_hot_text_spread_over_cells(spark, monkeypatch):
    """One text holds a third of the rows; with small cells it has many, and its slots still have no gaps."""
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    rng = random.Random(3)
    made = [(i, "hot " * 10 if i % 3 == 0 else f"text {rng.randrange(400)} " * rng.randrange(1, 30), None, None, None) for i in range(1500)]
    docs = spark.createDataFrame(made, DOCUMENT)
    found = check(docs)
    assert len({r["slot"] for r in found if r["doc_id"] % 3 == 0}) == 500
    cells = sharding._ordered_cells(sharding._keyed(docs, "doc_id", "text", 75).drop("_row"), 6)
    assert cells.agg(F.max("rows")).first()[0] < 30


def test_rows_that_agree_in_id_and_text_are_spread(spark, monkeypatch):
    """A third of the rows has neither id nor text, and a sixth one id and one text."""
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    rng = random.Random(4)
    made = [
        (None, None, None, None, None) if i % 3 == 0 else (7, "hot", None, None, None) if i % 6 == 1
        else (i, f"text {rng.randrange(400)} " * rng.randrange(1, 30), None, None, None)
        for i in range(1500)
    ]
    docs = spark.createDataFrame(made, DOCUMENT)
    check(docs)
    starts = sharding._starts(sharding._keyed(docs, "doc_id", "text", 75))
    runs = sharding._keyed(docs, "doc_id", "text", 75).groupBy(*sharding._CELL, "id_hash", "copy").count()
    assert runs.agg(F.max("count")).first()[0] < 30 and starts.count() == runs.count()


def test_slots_go_by_text_part_and_id(table):
    docs = table("documents")
    found = sharding.assign_shards(docs).select("doc_id", "shard", "slot").collect()
    value = F.coalesce("text", F.lit(""))
    order = [F.xxhash64(value), F.crc32(value), F.col("doc_id")]  # one part at this size
    wanted = [r.doc_id for r in docs.orderBy(*order).select("doc_id").collect()]
    assert [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot))] == wanted


def test_empty_table(none):
    assert sharding.assign_shards(none).count() == 0


def test_written_shards_hold_all_rows(spark, table, tmp_path):
    docs = table("documents")
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert rows(back, *docs.columns) == rows(docs, *docs.columns)
    placed = sharding.assign_shards(docs)
    assert rows(back, "doc_id", "shard", "slot") == rows(placed, "doc_id", "shard", "slot")


def test_no_python_in_the_plan(table):
    plan = sharding.assign_shards(table("documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert ODD_ROWS
