"""Perspective rotation: each dialogue once per participant, with that speaker as the assistant.

Everyone but the system speaker is a participant. In a participant's rendering, their turns are the assistant's and
masked in; all other turns are users', by name. A dialogue comes in parts of ``PART_TURNS`` turn numbers and, where one
part holds more than ``PART_ROWS`` rows, subs of so many rows by rank, so no dialogue is gathered whole, however long;
parts in order of (part, sub) make up the dialogue. Ranks come from a sort by range over all tasks and the counts of
each task, so no task sorts a whole dialogue.

Null roles are ``unknown``, null texts empty, null turns come first, as part -1; rows without a conv_id are one
dialogue, whose id is null. Rows equal in all four columns count once; equal turn numbers are ordered by role, then
text. A dialogue with only system turns has no participants and gives no rows. Marker openings inside texts
and roles are broken up, and so are marker ends and line breaks inside roles, so neither can fake a turn; roles that are
then alike are one participant. An empty table gives an empty result; further columns are not looked at. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import rows_of, saved, small_side, workspace

SYSTEM = "system"
PART_TURNS, PART_ROWS = 64, 4096
END = "<|end|>\n"


def header(role: Column, speaker: Column) -> Column:
    return F.when(role == speaker, F.lit("<|assistant|>\n")).when(role == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def rendered(turns: Column, speaker: Column) -> Column:
    """Struct of the text and the ranges of it that are the speaker's (text and end marker)."""

    def add(acc: Column, t: Column) -> Column:
        head, body = header(t["role"], speaker), F.concat(t["text"], F.lit(END))
        start = acc["pos"] + F.length(head)
        span = F.when(t["role"] == speaker, F.array(F.struct(start.alias("s"), (start + F.length(body)).alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
        return F.struct((start + F.length(body)).alias("pos"), F.concat(acc["mask"], span).alias("mask"))

    text = F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"], speaker), t["text"], F.lit(END))), "")
    mask = F.aggregate(turns, F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<s:int,e:int>>").alias("mask")), add, lambda acc: acc["mask"])
    return F.struct(text.alias("text"), mask.alias("mask"))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equal in the columns ``names`` of the one and ``_name`` of the other, nulls included."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[f"_{name}"])
    return out


def ranked(turns: DataFrame, full: DataFrame) -> DataFrame:
    """The rows of the parts in ``full`` (_conv_id, _part), with ``sub``: rank in the part div ``PART_ROWS``."""
    order = ["conv_id", "part", "turn", "role", "text"]
    some = turns.join(small_side(full), same(turns, full, "conv_id", "part"), "left_semi")
    placed = saved(some.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    task = F.shiftright("pos", 33)  # ids have the task in their upper bits, and ascend within it
    held = placed.groupBy(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"), task.alias("_task")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    # One row for each task that holds rows of the part.
    earlier = Window.partitionBy("_conv_id", "_part").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    held = saved(held.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    placed = placed.withColumn("task", task)
    both = placed.join(small_side(held), same(placed, held, "conv_id", "part", "task"))
    return both.select("conv_id", "turn", "role", "text", "part", F.floor((F.col("pos") - F.col("first") + F.col("before")) / PART_ROWS).alias("sub"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, part, sub, n_turns, text, mask (array of s, e)."""
    safe = lambda c: F.regexp_replace(c, r"<\|", "< |")
    turns = conversations.select(
        "conv_id",
        "turn",
        F.translate(F.replace(safe(F.coalesce("role", F.lit("unknown"))), F.lit("|>"), F.lit("| >")), "\r\n", "  ").alias("role"),
        safe(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-1)).alias("part"),
    ).distinct()
    with workspace(conversations.sparkSession) as keep:
        turns = saved(turns)
        full = saved(turns.groupBy(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part")).agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS))
        dealt = turns.withColumn("sub", F.lit(0).cast("long"))
        if rows_of(full):
            dealt = dealt.join(small_side(full), same(dealt, full, "conv_id", "part"), "left_anti").unionByName(ranked(turns, full))
        parts = saved(dealt.groupBy("conv_id", "part", "sub").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text"))).alias("turns")))
        speakers = saved(turns.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_conv_id"), F.col("role").alias("perspective")).distinct())
        keep += [parts, speakers]
    both = parts.join(small_side(speakers), same(parts, speakers, "conv_id")).withColumn("r", rendered(F.col("turns"), F.col("perspective")))
    return both.select("conv_id", "perspective", F.col("part").cast("long"), "sub", F.size("turns").cast("long").alias("n_turns"), "r.text", "r.mask")


def rotation_table(conversations: DataFrame) -> DataFrame:
    """``rotate`` with the mask as text, ``s:e`` comma-joined."""
    return rotate(conversations).withColumn("mask", F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["s"], x["e"])), ","))


def rotation_sql(part_turns: int = PART_TURNS, part_rows: int = PART_ROWS) -> str:
    """``rotation_table`` in DuckDB's dialect."""
    return f"""
WITH d AS (
  SELECT DISTINCT conv_id, turn, translate(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >'), chr(13) || chr(10), '  ') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text,
         coalesce(CAST(floor(turn / {part_turns}) AS BIGINT), -1) AS part
  FROM conversations
), t AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1) // {part_rows} AS BIGINT) AS sub
  FROM d
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
seg AS (
  SELECT t.conv_id, perspective, part, sub, turn, role, text,
         CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = '{SYSTEM}' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || role || '|>' || chr(10) END AS head,
         text || '<|end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), pos AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (
           PARTITION BY conv_id, perspective, part, sub ORDER BY turn NULLS FIRST, role, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s
  FROM seg
)
SELECT conv_id, perspective, part, sub, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CASE WHEN role = perspective THEN CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + length(body) AS BIGINT) AS VARCHAR) END,
                  ',' ORDER BY turn NULLS FIRST, role, text), '') AS mask
FROM pos GROUP BY conv_id, perspective, part, sub
"""


ROTATION_SQL = rotation_sql()
