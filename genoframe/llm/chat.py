"""Multi-party perspective rotation: every participant's view of a dialogue, with training masks.

DataFrame operations only.  A dialogue is rendered as segments, one row for each perspective and
turn with its place in the whole rendering, so a dialogue of any length spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import running

#: Turns in a bucket of the running positions.
TURNS = 32
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _escaped(text: Column) -> Column:
    """Control marks inside a text lose their meaning: a space parts '<' and '|'."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _named(speaker: Column) -> Column:
    """A speaker's name as it stands in a header, which is one line."""
    return F.regexp_replace(_escaped(speaker), "[\r\n]", " ")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """Segments: conv, perspective, seq, turn, role, name, segment, start, stop, mask_start, mask_stop.

    For each participant (each distinct speaker but ``system``) of a conversation, that
    speaker's turns have the role assistant, other speakers' turns the role user with the
    speaker's name, and system turns the role system.  ``segment`` is the rendered turn; the
    segments in ``seq`` order are the rendered dialogue, and start/stop are code point offsets
    in it.  mask_start/mask_stop bound what the perspective trains on (its own texts with their
    end marks) and are null elsewhere.

    Line ends in a speaker's name are spaces in the header.  Turns are ordered by turn number (null first), then speaker, then text.  Null speakers are
    named by the empty string, null texts are empty, a null conversation id is a conversation of
    its own.  Repeated rows are turns each.  Conversations of system turns alone have no
    participant and give no row.
    """
    key = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("none"))
    bucket = F.coalesce(F.floor(F.col(turn_col) / TURNS), F.lit(-1 << 60))
    t = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key"), bucket.alias("at"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text")]
    t = running(t, ["key"], F.col("at"), order, F.lit(1), "seq")
    some = turns.select(key.alias("key"), bucket.alias("at"), F.coalesce(F.col(role_col), F.lit("")).alias("speaker")).groupBy("key", "at").agg(F.collect_set("speaker").alias("speakers"))
    every = some.groupBy("key").agg(F.array_remove(F.array_distinct(F.flatten(F.collect_list("speakers"))), system).alias("perspectives"))
    views = t.join(some.select("key", "at").join(every, "key"), ["key", "at"]).withColumn("perspective", F.explode("perspectives"))
    own, of_system = F.col("speaker") == F.col("perspective"), F.col("speaker") == system
    head = F.when(of_system, f"{OPEN}system\n").when(own, f"{OPEN}assistant\n").otherwise(F.concat(F.lit(f"{OPEN}user name="), _named(F.col("speaker")), F.lit("\n")))
    views = views.withColumns({"head": head, "segment": F.concat(head, _escaped(F.col("text")), F.lit(f"{CLOSE}\n"))})
    placed = running(views, ["key", "perspective"], F.col("at"), [F.col("seq")], F.char_length("segment"), "start")
    stop = F.col("start") + F.char_length("segment")
    return placed.select(
        F.col("conv").alias(conv_col), "perspective", F.col("seq").cast("long").alias("seq"), F.col("turn").alias(turn_col),
        F.when(of_system, "system").when(own, "assistant").otherwise("user").alias("role"), F.when(~of_system & ~own, F.col("speaker")).alias("name"), "segment",
        F.col("start").cast("long").alias("start"), stop.cast("long").alias("stop"),
        F.when(own, F.col("start") + F.char_length("head")).cast("long").alias("mask_start"), F.when(own, stop - 1).cast("long").alias("mask_stop"),
    )


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS seq
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (
  SELECT t.*, perspective,
         CASE WHEN speaker = 'system' THEN '{OPEN}system' WHEN speaker = perspective THEN '{OPEN}assistant'
              ELSE '{OPEN}user name=' || regexp_replace(replace(speaker, '<|', '< |'), '[\\r\\n]', ' ', 'g') END || chr(10) AS head,
         replace(text, '<|', '< |') || '{CLOSE}' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM v)
SELECT conv_id, perspective, seq, turn,
       CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
       CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name,
       head || body AS segment, start, start + length(head) + length(body) AS stop,
       CASE WHEN speaker = perspective THEN start + length(head) END AS mask_start,
       CASE WHEN speaker = perspective THEN start + length(head) + length(body) - 1 END AS mask_stop
FROM s"""
