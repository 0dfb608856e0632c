"""Which format the dates of a text column are in, found from all of its values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillflow.functions import parse_date
from tillflow.schema import BASE_TYPES
from tillflow.scratch import settle

# Formats that order-line exports use, the most usual one first.
CANDIDATES = ("M/d/yyyy", "d/M/yyyy", "yyyy-M-d", "yyyy/M/d", "d.M.yyyy", "d-M-yyyy", "M-d-yyyy")
DATES = tuple(c for c, t in BASE_TYPES.items() if t.typeName() == "date")


def date_formats(df: DataFrame, columns: Sequence[str] = DATES, candidates: Sequence[str] = CANDIDATES, by: Sequence[str] = ()) -> DataFrame:
    """The format of each column of text, for each value of ``by`` (such as the file): (by, column_name, format, parsed, filled, tied).

    ``parsed`` of the ``filled`` values are dates in the format that reads the most. Formats that read as many values, and
    not all of them as the same dates, are a tie: they are listed in ``tied`` and ``format`` is NULL, as it is where no
    candidate reads any value. One pass over all rows counts the texts, of which a calendar has few; each text is then read in
    every format once, and counts as often as it occurs: per format a count and a checksum of the dates.
    """
    def score(column: str) -> Column:
        value, rows = F.when(F.col("_column") == column, F.col("_text")), F.col("_rows")
        formats = []
        for i, pattern in enumerate(candidates):
            date = parse_date(value, pattern)
            marks = F.sum(F.when(date.isNotNull(), F.xxhash64(date).cast("decimal(38,0)") * rows))
            parsed = F.coalesce(F.sum(F.when(date.isNotNull(), rows)), F.lit(0))
            formats.append(F.struct(parsed.alias("n"), F.lit(-i).alias("place"), F.lit(pattern).alias("format"), marks.alias("sum")))
        filled = F.coalesce(F.sum(F.when(value.isNotNull(), rows)), F.lit(0))
        return F.struct(F.lit(column).alias("column_name"), filled.alias("filled"), F.array(*formats).alias("formats"))

    groups = [F.col(f"`{c}`") for c in by]
    each = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(f"`{c}`").alias("_text")) for c in columns])
    texts = df.select(*groups, F.inline(each)).groupBy(*groups, "_column", "_text").agg(F.count("*").alias("_rows"))
    scored = texts.groupBy(*groups).agg(F.array(*[score(c) for c in columns]).alias("scores")).select(*groups, F.explode("scores").alias("s"))
    best = F.array_max("s.formats")
    alike = F.filter("s.formats", lambda f: (f["n"] == F.col("best")["n"]) & (f["n"] > 0))
    others = F.exists("alike", lambda f: f["sum"] != F.col("best")["sum"])
    told = scored.withColumn("best", best).withColumn("alike", alike).withColumn("ties", others)
    return told.select(
        *groups, F.col("s.column_name"),
        F.when((F.col("best.n") > 0) & ~F.col("ties"), F.col("best.format")).alias("format"),
        F.col("best.n").alias("parsed"), F.col("s.filled"),
        F.when(F.col("ties"), F.transform("alike", lambda f: f["format"])).alias("tied"),
    )


def _checked(found: Sequence[Mapping]) -> None:
    for row in found:
        if row["tied"]:
            raise ValueError(f"The dates of {row['column_name']} read as well as {' or '.join(row['tied'])}: name one of them.")


def infer_date_format(df: DataFrame, columns: Sequence[str] = DATES, candidates: Sequence[str] = CANDIDATES) -> str:
    """The one format of all the columns together. A tie raises and names the formats; so does text without any date."""
    tall = df.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias(" and ".join(columns)))
    row = date_formats(tall, tall.columns, candidates).first()
    _checked([row])
    if row["format"] is None:
        raise ValueError(f"No date of {row['column_name']} is in any of the formats {', '.join(candidates)}.")
    return row["format"]


def parse_mixed_dates(df: DataFrame, columns: Sequence[str] = DATES, candidates: Sequence[str] = CANDIDATES, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``columns`` as dates, each group of ``by`` in its own format. A tie raises, and names the first one.

    The formats are found in one pass, written, and joined to the rows; values that the format does not read become NULL.
    """
    found = settle(date_formats(df, columns, candidates, by), "formats")  # one row a group and column
    _checked(found.where("tied IS NOT NULL").limit(1).collect())
    if not by:
        formats = {r["column_name"]: r["format"] for r in found.collect()}  # one row a column
        read = {c: parse_date(F.col(f"`{c}`"), p) if p else F.lit(None).cast("date") for c, p in formats.items()}
        return df.select(*[read[c].alias(c) if c in read else F.col(f"`{c}`") for c in df.columns])
    chosen = found.groupBy(*[F.col(f"`{c}`") for c in by]).pivot("column_name", list(columns)).agg(F.first("format"))
    chosen = chosen.select(*[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)], *[F.col(f"`{c}`").alias(f"_format_{c}") for c in columns])
    joined = df.join(chosen, [df[c].eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], "left")

    def parsed(column: str) -> Column:
        return F.coalesce(*[F.when(F.col(f"_format_{column}") == p, parse_date(F.col(f"`{column}`"), p)) for p in candidates])

    return joined.select(*[parsed(c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
