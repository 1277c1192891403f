"""Chat formatting by perspective rotation, in DataFrame functions only.

A dialogue of several parties is rendered once for every participant: that
speaker's turns as the assistant's, all others' as named users', system turns as
they are, and a mask that covers what the assistant says. Long dialogues come in
parts of ``part_turns`` turn numbers, and every part in runs of ``part_turns`` different
rows in their order (rows may share turn numbers), so no group grows with a dialogue;
joined in order of part, first_turn and tie, the runs of a perspective are the whole
dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

PART_TURNS = 256
#: Characters of a text by which rows are dealt out in order; within a task all count.
DEALT = 256
SYSTEM = "system"
UNKNOWN = "unknown"
#: The markers of a rendering.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>"


def _head(speaker: Column, perspective: Column) -> Column:
    who = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(OPEN), who, F.lit(CLOSE))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Equality of columns that ``b`` has under ``_`` names, nulls being equal."""
    same = F.lit(True)
    for k in names:
        same &= a[k].eqNullSafe(b[f"_{k}"])
    return same


def _sorted(turns: DataFrame, key: list[str]) -> DataFrame:
    """``turns``, different rows, sorted across tasks wherever a part begins, and stored
    with their task and their number, which grows within it."""
    dealt = turns.repartitionByRange(*key, F.col("t.turn"), F.col("t.speaker"), F.left("t.said", F.lit(DEALT))).sortWithinPartitions(*key, "t")
    return stored(dealt.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("n")), "chat-sorted")


def _runs(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """(key, t, tie) of ``_sorted`` rows: ``tie`` is the number, from 0, of the row's run of
    ``size`` rows of its part, by how many of the part come in earlier tasks."""
    held = rows.groupBy(*key, "task").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    # A row per part and task that has some of it.
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(*key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = held.select(*[F.col(k).alias(f"_{k}") for k in (*key, "task")], (F.col("first") - before).alias("begin"))
    return rows.join(begin, _same(rows, begin, [*key, "task"])).select(*key, "t", F.floor((F.col("n") - F.col("begin")) / size).alias("tie"))


def rotate(conversations: DataFrame, *, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, perspective, part, first_turn, tie, n_turns, n_target_turns, rendered, mask) from
    ``conversations`` (conv_id, turn, role, text; other columns are ignored).

    ``mask`` lists the half-open character spans of ``rendered`` that the
    perspective's speaker says, end marker included. Turns are in order of turn,
    then speaker, then text, within and across parts; equal rows count once. ``tie``
    is the number of the run in its part, from 0. A null role is the speaker
    ``unknown``, a null text is empty. A row without turn number is a part of
    its own (part null) of its dialogue, a row without conv_id a dialogue of its
    own. A dialogue of system turns alone has no participant and gives no rows.
    ``<|`` inside a text becomes ``< |``.
    """
    said = F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit("< |"))
    mark = F.xxhash64("turn", "role", "text")
    turns = conversations.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), mark).otherwise(F.lit(0)).alias("lone"),
        F.floor(F.col("turn") / part_turns).alias("part"),
        F.when(F.col("turn").isNull(), mark).otherwise(F.lit(0)).alias("loose"),
        F.struct("turn", F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"), said.alias("said")).alias("t"),
    )
    key = ["conv_id", "lone", "part", "loose"]
    rows = _sorted(turns.distinct(), key)
    parts = _runs(rows, key, part_turns).groupBy(*key, "tie").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    seats = rows.filter(F.col("t.speaker") != SYSTEM).select(F.col("conv_id").alias("_conv_id"), F.col("lone").alias("_lone"), F.col("t.speaker").alias("perspective")).distinct()
    each = parts.join(seats, _same(parts, seats, ["conv_id", "lone"]))

    me = F.col("perspective")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(so_far: Column, t: Column) -> Column:
        begin = so_far.at + F.length(_head(t.speaker, me))
        end = begin + F.length(t.said) + len(END)
        span = F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))
        return F.struct((end + 1).alias("at"), F.when(t.speaker == me, F.concat(so_far.spans, span)).otherwise(so_far.spans).alias("spans"))

    return each.select(
        "conv_id",
        "perspective",
        "part",
        F.col("turns")[0]["turn"].alias("first_turn"),
        "tie",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t.speaker == me)).cast("long").alias("n_target_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(_head(t.speaker, me), t.said, F.lit(END + "\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("turns", start, step).spans, ",").alias("mask"),
    )


#: The same in DuckDB SQL, for rows with conv_id and turn.
ROTATE_SQL = f"""
WITH t AS (
  SELECT *, floor(turn / {PART_TURNS})::BIGINT AS part FROM (
    SELECT DISTINCT conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations)
), r AS (
  SELECT *, ((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, speaker, said) - 1) // {PART_TURNS})::BIGINT AS tie
  FROM t
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'
), s AS (
  SELECT r.*, perspective,
    '<|' || CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || '|>' || chr(10) AS head
  FROM r JOIN p USING (conv_id)
), o AS (
  SELECT *, sum(length(head) + length(said) + 8) OVER (PARTITION BY conv_id, perspective, part, tie ORDER BY turn, speaker, said ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM s
)
SELECT conv_id, perspective, part, min(turn) AS first_turn, tie, count(*) AS n_turns,
  count(*) FILTER (WHERE speaker = perspective) AS n_target_turns,
  string_agg(head || said || '<|end|>' || chr(10), '' ORDER BY turn, speaker, said) AS rendered,
  coalesce(string_agg((stop - length(said) - 8) || '-' || (stop - 1), ',' ORDER BY turn, speaker, said) FILTER (WHERE speaker = perspective), '') AS mask
FROM o GROUP BY conv_id, perspective, part, tie
"""
