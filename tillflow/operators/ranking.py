"""Exact ranks and positions over tables too large for one task.

``Window.orderBy`` without ``partitionBy`` sorts the whole table in a single task. Here values are laid out in cells, which a
formula gives without a look at the data: 64 to each doubling, so a cell is about one percent wide. Cells are in the order
of their values, so what lies below a value is the rows of lower cells, a running sum over a few thousand counts, and what
lies below it in its own cell. Ranks count values and not rows: equal values are one row before anything is ordered, so
a value (or NULL) that holds a third of the rows is no more work than another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tillflow.scratch import settle

_CELLS = 64  # to each doubling
_ZERO = 1 << 17  # more than a double has cells below 1
# monotonically_increasing_id(): task number in the upper bits, position in the task below.
_TASK_BITS = 33


def cell_sql(value: str, nulls: str) -> str:
    """The cell of a number; of equal or larger numbers it is equal or larger. NULL lies beyond all, ``nulls`` low or high."""
    size = f"int({_ZERO} + floor(least({2 * _ZERO}, {_CELLS} * log2(abs({value})))))"  # NaN is the largest number
    end = f"{'-' if nulls == 'low' else ''}{1 << 20}"
    return f"CASE WHEN {value} IS NULL THEN {end} WHEN {value} > 0 THEN {size} WHEN {value} < 0 THEN -{size} ELSE 0 END"


def rank_sql(source: str, ranks: Mapping[str, str], partition_by: Sequence[str] = (), weight: str = "1", ties: Mapping[str, str] | None = None) -> str:
    """``RANK() OVER (PARTITION BY .. ORDER BY metric DESC NULLS FIRST)`` of the query ``source``, evenly distributed.

    ``ranks`` names the new column for each metric, and ``ties`` one for the number of rows that share its value. A row counts
    as ``weight`` rows. Values are counted, their counts summed by cell, and ranks joined to
    the rows by value; a partition, which may hold most of the rows, is spread over cells like the table as a whole. The
    text states ``source`` several times, and Spark computes its grouping once.
    """
    owner = [f"_o{i}" for i in range(len(partition_by))]
    owners = "".join(f"{o}, " for o in owner)
    renamed = "".join(f"{c} AS {o}, " for c, o in zip(partition_by, owner, strict=True))
    groups = "PARTITION BY " + ", ".join(owner) if owner else ""
    parts, joins, columns = [], [], []
    for i, (metric, name) in enumerate(ranks.items()):
        same = " AND ".join([f"v.{o} <=> a.{o}" for o in owner] + ["v._cell = a._cell"])
        parts.append(f"""_values{i} AS (
  SELECT {renamed}{metric} AS _v, {cell_sql(metric, "high")} AS _cell, sum({weight}) AS _n FROM _source GROUP BY ALL
), _above{i} AS (
  SELECT {owners}_cell, coalesce(sum(sum(_n)) OVER ({groups} ORDER BY _cell DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _above
  FROM _values{i} GROUP BY {owners}_cell
), _ranks{i} AS (
  SELECT {"".join(f"v.{o}, " for o in owner)}v._v, v._n, a._above + 1 + coalesce(sum(v._n) OVER (
    PARTITION BY {"".join(f"v.{o}, " for o in owner)}v._cell ORDER BY v._v DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _rank
  FROM _values{i} v JOIN _above{i} a ON {same}
)""")
        on = " AND ".join([f"s.{c} <=> r{i}.{o}" for c, o in zip(partition_by, owner, strict=True)] + [f"s.{metric} <=> r{i}._v"])
        joins.append(f"JOIN _ranks{i} r{i} ON {on}")
        columns.append(f"r{i}._rank AS {name}")
        if ties and metric in ties:
            columns.append(f"r{i}._n AS {ties[metric]}")
    return f"WITH _source AS ({source}), " + ", ".join(parts) + f"\nSELECT s.*, {', '.join(columns)} FROM _source s " + " ".join(joins)


def add_ranks(
    df: DataFrame, ranks: Mapping[str, str], partition_by: Sequence[str] = (), weight: str = "1", ties: Mapping[str, str] | None = None,
) -> DataFrame:
    """:func:`rank_sql` of a DataFrame."""
    return df.sparkSession.sql(rank_sql("SELECT * FROM {df}", ranks, partition_by, weight, ties), df=df)


def rows_at(written: DataFrame, metrics: Sequence[str], keys: Sequence[str], positions: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], Row]:
    """The rows of ``written`` at the given 1-based positions of the order by each metric and then ``keys``.

    ``written`` is a table that is cheap to read again; ``keys`` make its rows distinct; NULLs come first. Metrics are compared
    in one type that holds them all. Rows are counted by metric and cell; only cells that hold a wanted position are sorted,
    all of them in one distributed sort that may cut a run of equal values anywhere; and a row's place in the sorted table
    tells its position. What reaches the driver is one row for each position, cell that holds one, and sort task.
    """
    tall = written.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_metric"), F.col(m).alias("_value"), F.expr(cell_sql(m, "low")).alias("_cell"), *[F.col(k) for k in keys])
        for i, m in enumerate(metrics)
    ])).alias("r")).select("r.*")
    wanted = [(i, p) for i, m in enumerate(metrics) for p in positions[m]]
    if not wanted:
        return {}
    counts = tall.groupBy("_metric", "_cell").agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy("_metric").orderBy("_cell"))  # a few thousand cells a metric
    holds = [(F.col("_metric") == i) & (F.col("_last") >= p) & (F.col("_last") - F.col("_n") < p) for i, p in wanted]
    cells = counts.withColumn("_last", up_to).where(sum([h.cast("int") for h in holds], F.lit(0)) > 0).collect()
    chosen = [(F.col("_metric") == c["_metric"]) & (F.col("_cell") == c["_cell"]) for c in cells]
    order = [F.col("_metric").asc(), F.col("_value").asc_nulls_first(), *[F.col(k).asc_nulls_first() for k in keys]]
    kept = tall.where(sum([c.cast("int") for c in chosen], F.lit(0)) > 0)
    laid = settle(kept.sort(*order).withColumn("_slot", F.monotonically_increasing_id()), "cells")
    runs = (
        laid.groupBy("_metric", "_cell", F.shiftright("_slot", _TASK_BITS).alias("_task"))
        .agg(F.min("_slot").alias("first"), F.count("*").alias("n")).orderBy("_metric", "_cell", "_task").collect()
    )
    slots = {}
    for i, p in wanted:
        cell = next(c for c in cells if c["_metric"] == i and c["_last"] - c["_n"] < p <= c["_last"])
        left = p - (cell["_last"] - cell["_n"])
        for run in runs:
            if (run["_metric"], run["_cell"]) == (i, cell["_cell"]):
                if left <= run["n"]:
                    slots[metrics[i], p] = run["first"] + left - 1
                    break
                left -= run["n"]
    found = {r["_slot"]: r for r in laid.where(F.col("_slot").isin(list(slots.values()))).collect()}
    return {place: found[slot] for place, slot in slots.items()}


def number_rows(df: DataFrame, order: Sequence[Column], name: str, keep: Sequence[str] | None = None) -> DataFrame:
    """``ROW_NUMBER()`` over a total order of the whole table, beside all columns or those to ``keep``.

    Runs the sort: it is written once to the shared folder, and a row's number is its place in its task's output plus the
    rows of the tasks before it. ``order`` must be total; Spark then cuts the sort ranges anywhere, also inside a run of
    equal leading values.
    """
    kept = df.columns if keep is None else keep
    laid = settle(df.sort(*order).select(*kept, F.monotonically_increasing_id().alias("_slot")), "sorted")
    sizes = laid.groupBy(F.shiftright("_slot", _TASK_BITS).alias("_task")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per write task
    first = sizes.select("_task", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    in_task = F.col("_slot").bitwiseAND((1 << _TASK_BITS) - 1)
    return (
        laid.withColumn("_task", F.shiftright("_slot", _TASK_BITS))
        .join(F.broadcast(first), "_task")
        .select((F.col("_before") + in_task + 1).alias(name), *kept)
    )
