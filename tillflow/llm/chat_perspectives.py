"""Multi-party chat formatting: each participant in turn is the assistant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillflow.llm.shared import settle

TURNS_PER_PART = 512  # a longer dialogue is rendered in consecutive parts, so no row or task holds an endless one
SYSTEM_ROLES = ("system",)
UNKNOWN = "unknown"
# The rendered form of a turn: an opening tag, the text, an end tag.
END = "<|end|>\n"
ASSISTANT = "<|assistant|>\n"
SYSTEM = "<|system|>\n"
_TASK_BITS = 33  # of monotonically_increasing_id(): the task's number is above, the position in the task below


def _numbered(turns: DataFrame) -> DataFrame:
    """Adds ``position`` of each turn in its conversation, from 0, by turn, speaker and text.

    One distributed sort over all of these columns, so that a conversation with very many turns is spread over tasks; a
    row's number is its place in its task's output and the rows of the tasks before it.
    """
    order = ["conv", F.col("turn").asc_nulls_last(), "speaker", "text"]
    laid = settle(turns.sort(*order).withColumn("slot", F.monotonically_increasing_id()), "turns")
    sizes = laid.groupBy(F.shiftright("slot", _TASK_BITS).alias("task")).count().collect()  # a row per write task
    before, starts = 0, []
    for task, n in sorted((r["task"], r["count"]) for r in sizes):
        starts.append((task, before))
        before += n
    first = F.broadcast(turns.sparkSession.createDataFrame(starts, "task long, before long"))
    in_task = F.col("slot").bitwiseAND((1 << _TASK_BITS) - 1)
    rows = laid.withColumn("task", F.shiftright("slot", _TASK_BITS)).join(first, "task").withColumn("line", F.col("before") + in_task)
    begins = rows.groupBy("conv").agg(F.min("line").alias("begin"))
    return rows.join(begins, "conv").withColumn("position", F.col("line") - F.col("begin")).drop("task", "before", "line", "begin", "slot")


def _segments(perspective: Column, system: Sequence[str]) -> Column:
    def one(turn: Column) -> Column:
        speaker = turn["speaker"]
        head = (
            F.when(speaker.isin(*system), F.lit(SYSTEM))
            .when(speaker == perspective, F.lit(ASSISTANT))
            .otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))
        )
        return F.struct(head.alias("head"), F.concat(turn["text"], F.lit(END)).alias("body"), (speaker == perspective).alias("own"))

    return F.transform("turns", one)


def _mask(segments: Column) -> Column:
    """Character ranges [start, stop) of the assistant's bodies, end tags included."""
    span = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.slice(F.array(span), 1, 0).alias("spans"))

    def step(state: Column, segment: Column) -> Column:
        start = state["at"] + F.char_length(segment["head"])
        stop = start + F.char_length(segment["body"])
        own = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(segment["own"], F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(segments, empty, step, lambda state: state["spans"])


def rotate_perspectives(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                        system_roles: Sequence[str] = SYSTEM_ROLES, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row per conversation, participant and part: conv_id, perspective, part, n_turns, text and mask.

    The participant in ``perspective`` speaks as the assistant, all others as users with their names; ``mask`` lists the
    character ranges of ``text`` that the assistant says, which is what a model may be trained on. Instructions of
    ``system_roles`` stay as they are and are no participant. Tags inside texts and names are broken up. Turns go by number,
    null last, and of equal numbers by speaker and text; repeated turns are all rendered. A null role is the speaker
    ``unknown``, a null text empty, and a null id a conversation of its own. A conversation without participants gives
    no rows.
    """
    clean = lambda value, default: F.replace(F.coalesce(value.cast("string"), F.lit(default)), F.lit("<|"), F.lit("< |"))
    turns = conversations.select(
        F.struct(F.col(f"`{conv}`").alias("id")).alias("conv"), F.col(f"`{turn}`").alias("turn"),
        clean(F.col(f"`{role}`"), UNKNOWN).alias("speaker"), clean(F.col(f"`{text}`"), "").alias("text"),
    )
    speakers = turns.where(~F.col("speaker").isin(*system_roles)).select("conv", F.col("speaker").alias("perspective")).distinct()
    parts = (
        _numbered(turns)
        .withColumn("part", F.floor(F.col("position") / turns_per_part).cast("long"))
        .groupBy("conv", "part")
        .agg(F.array_sort(F.collect_list(F.struct("position", "speaker", "text"))).alias("turns"))  # turns_per_part at most
    )
    rendered = parts.join(speakers, "conv").withColumn("segments", _segments(F.col("perspective"), system_roles))
    return rendered.select(
        F.col("conv.id").alias("conv_id"), "perspective", "part", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("text"),
        _mask(F.col("segments")).alias("mask"),
    )


def perspective_report(conversations: DataFrame) -> DataFrame:
    """The renderings with the mask as text, ``start-stop`` ranges joined by commas."""
    ranges = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string")))
    return rotate_perspectives(conversations).withColumn("mask", F.array_join(ranges, ","))


def oracle(turns_per_part: int = TURNS_PER_PART) -> str:
    """The result of :func:`perspective_report` in SQL for DuckDB."""
    end, assistant, system = (f"'{t.strip()}' || chr(10)" for t in (END, ASSISTANT, SYSTEM))
    return f"""
WITH turns AS (
  SELECT conv_id, turn, replace(coalesce(role, '{UNKNOWN}'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, text) - 1 AS position FROM turns
), speakers AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), segments AS (
  SELECT n.conv_id, s.perspective, n.position // {turns_per_part} AS part, n.position, n.speaker = s.perspective AS own,
    CASE WHEN n.speaker = 'system' THEN {system} WHEN n.speaker = s.perspective THEN {assistant}
      ELSE '<|user name=' || n.speaker || '|>' || chr(10) END AS head,
    n.text || {end} AS body
  FROM numbered n JOIN speakers s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY position) AS stop FROM segments
)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY position) AS text,
  coalesce(string_agg(CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY position)
    FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, perspective, part"""
