"""How filters interact: what each removes at each step of every order, from difference arrays over ranks of orders."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tillflow.llm.shared import settle

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SYMBOLS = "[#$%&*|]"
_SPACE = r"[\x20\x09-\x0D]+"
_COUNTS = ("documents", "good", "toxic")


def lehmer_rank(order: tuple[int, ...], n: int) -> int:
    """Lexicographic rank of the first permutation of 0..n-1 that starts with ``order``."""
    left, rank = list(range(n)), 0
    for at, item in enumerate(order):
        rank += left.index(item) * factorial(n - 1 - at)
        left.remove(item)
    return rank


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) where a document that fails the filters of ``mask`` goes at ``step``.

    All orders that begin with the same filters are neighbours in lexicographic order. A document goes where the first
    filter of its mask stands, so each beginning of other filters with one of the mask's at its end is one interval.
    """
    made = []
    for step in range(1, n + 1):
        for start in permutations(range(n), step):
            first = lehmer_rank(start, n)
            for mask in range(1 << n):
                if mask >> start[-1] & 1 and not any(mask >> f & 1 for f in start[:-1]):
                    made.append((mask, step, first, first + factorial(n - step)))
    return made


def failures(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, part, digest, mask) of each row; the mask has a bit for each of the first four filters it fails.

    ``digest`` is the SHA-256 of the text. A null text is empty, and a null source is the part ''.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    read = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"),
        content.alias("text"), F.array_remove(F.split(content, _SPACE), "").alias("words"),
    )
    n_words = F.size("words")
    failing = (
        n_words < MIN_WORDS,
        F.size(F.array_distinct("words")) * 100 < n_words * MIN_DISTINCT_PERCENT,
        F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * MAX_CAPITALS_PERCENT,
        F.col("text").rlike(SYMBOLS),
    )
    mask = sum([F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failing)], F.lit(0))
    return read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def _add_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` (digest, doc_id, ...) with ``bit`` in the mask of those whose digest a smaller id has as well.

    Joined on (digest, id), so the rows of a hot text are spread by their ids.
    """
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    joined = rows.join(first, ["digest", "doc_id"], "left")
    copied = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return joined.withColumn("mask", F.col("mask") + F.when(copied, 1 << bit).otherwise(0)).drop("_first")


def _add_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with 0/1 columns good and toxic; a document that any of its label rows marks is marked."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    known = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    unknown = rows.where("doc_id IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    return known.unionByName(unknown).fillna(0, ["good", "toxic"])


def failure_counts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, mask, documents, good, toxic): how many documents of each part fail exactly the filters of each mask.

    Equal (text, id, part) rows are counted before anything is joined, so that repeated rows travel as one.
    """
    rows = failures(docs, id_column, text, source).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    whole = _add_labels(_add_copies(settle(rows, "failures"), len(FILTERS) - 1), labels)
    return whole.groupBy("part", "mask").agg(
        F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def _constants(spark: SparkSession, n: int, names: str) -> tuple[DataFrame, DataFrame]:
    """Intervals, and the orders by rank; both depend on the number of filters only (840 and 120 rows for five)."""
    orders = [(rank, "".join(order)) for rank, order in enumerate(permutations(names))]
    return (
        spark.createDataFrame(removal_intervals(n), "mask int, step int, first int, stop int"),
        spark.createDataFrame(orders, "rank int, filter_order string"),
    )


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, from ``counts`` (part, mask, documents, good, toxic).

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. ``filters``
    are letters in ascending order; bit i of a mask stands for letter i. For each (part, step) the counts of a mask are
    added where one of its intervals of ranks begins and taken off where it ends; the running sum over the ranks is what
    goes at that step of each order. A part has a few hundred rows whatever its number of documents.
    """
    n = len(filters)
    intervals, orders = _constants(counts.sparkSession, n, filters)
    counts = settle(counts, "counts")
    ends = counts.join(F.broadcast(intervals), "mask").select(
        "part", "step", F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")),
                                          F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign")))).alias("end"), *_COUNTS,
    ).select("part", "step", "end.rank", *[(F.col(c) * F.col("end.sign")).alias(c) for c in _COUNTS])
    grid = (
        counts.select("part").distinct()
        .select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
        .select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    )
    changes = ends.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = changes.select("part", "step", "rank", *[F.sum(c).over(ranks).alias(c) for c in _COUNTS])
    gone = gone.join(F.broadcast(orders), "rank").withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))

    def by_letter(condition) -> Column:
        """Map from each letter to the documents whose mask meets ``condition`` of its bit."""
        sums = [(F.lit(f), F.sum(F.when(condition(1 << i), F.col("documents")).otherwise(0))) for i, f in enumerate(filters)]
        return F.create_map(*[c for pair in sums for c in pair])

    mask = F.col("mask")
    parts = counts.groupBy("part").agg(
        F.sum("documents").alias("total"), by_letter(lambda b: mask.bitwiseAND(b) > 0).alias("fails"), by_letter(lambda b: mask == b).alias("only"),
    )
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return gone.join(parts, "part").select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("documents").over(steps)).alias("kept"),
        F.col("documents").alias("removed"),
        (F.col("fails")[F.col("letter")] - F.col("documents")).alias("redundant"),
        F.col("only")[F.col("letter")].alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("documents").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def filter_report(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """:func:`audit` of the five filters over whole texts.

    A: fewer than 200 words; B: fewer than half of the words distinct; C: more than 2 % capitals A-Z; D: one of the
    symbols; E: a smaller id has the same text, whatever happens to that row. Null texts are empty; null sources are the
    part '', together with empty ones. A row without an id fails no E and has no label, and nothing is a copy of it.
    Repeated rows count each, and are no copies of each other. Texts of any length are read whole; an empty table gives
    no rows; other columns are not looked at.
    """
    return audit(failure_counts(docs, labels, id_column, text, source))


def oracle() -> str:
    """DuckDB SQL of the query's rows: each order is applied to each combination of failing filters."""
    first = " ".join(f"WHEN contains(fails, substr(filter_order, {s}, 1)) THEN {s}" for s in range(1, 6))
    letters = ", ".join(f"('{f}')" for f in FILTERS)
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), marked AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM texts
), marks AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS int)) AS good, max(CAST(coalesce(toxic = 1, false) AS int)) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM marked LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters(f) AS (VALUES {letters}), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)
), placed AS (
  SELECT *, CASE {first} ELSE 6 END AS gone FROM cells, orders
), stepped AS (
  SELECT *, substr(filter_order, step, 1) AS letter FROM placed, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS int) AS step)
), report AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (gone > step), 0) AS kept,
    coalesce(sum(n) FILTER (gone = step), 0) AS removed,
    coalesce(sum(n) FILTER (gone < step AND contains(fails, letter)), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (gone = step), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
  FROM stepped GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed, CAST(redundant AS bigint) AS redundant,
  CAST(unique_fails AS bigint) AS unique_fails, CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS bigint) AS shapley
FROM report"""
