"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

Method. A conversation's participants are its roles other than system. For each of them the whole dialogue is rendered once
more: that participant's turns as assistant, the others' as named users, system turns as system; the mask is 1 on the
assistant's content. A rendering is returned as its segments, one row a turn, with code-point offsets: laid in order of `start`
they are the whole string.

Scale. Offsets are prefix sums in two levels (inside blocks of turns, then over block totals), so a conversation that holds a
third of all rows is spread over its blocks; nothing gathers a conversation. Turns without a number are in blocks by hash; turns
that share one number are one block. Rows out: turns times participants.

A null text is empty; a null or empty role is the participant `unknown`; a null conv_id is a conversation; null turns come
first, in order of the md5 of role and text; turns of one number are ordered by role and text, so repeated rows follow each other; a conversation with system turns
only has no participant and no row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256
#: The markers around a segment.
OPEN, CLOSE = "<|start|>", "<|end|>\n"


def rotate_perspectives(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, start, content_start, stop, mask for every turn and participant."""
    role = F.when(F.coalesce(F.trim(F.col("role").cast("string")), F.lit("")) == "", "unknown").otherwise(F.trim(F.col("role").cast("string")))
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("loose", F.when(F.col("turn").isNull(), F.md5(F.concat_ws("|", "role", "text"))))
    number = F.when(F.col("turn").isNull(), F.conv(F.substring("loose", 1, 4), 16, 10).cast("long")).otherwise(F.floor(F.col("turn") / block_turns))
    t = t.withColumn("block", F.struct(F.col("turn").isNotNull().alias("numbered"), number.alias("number")))
    who = t.filter("role <> 'system'").select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective")).distinct()
    x = t.join(who, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    mine = F.col("role") == F.col("perspective")
    speaker = F.when(mine, "assistant").when(F.col("role") == "system", "system").otherwise(F.concat(F.lit("user name="), "role"))
    head = F.concat(F.lit(OPEN), speaker, F.lit("\n"))
    x = x.select("conv_id", "perspective", "turn", "block", "role", speaker.alias("speaker"), F.concat(head, "text", F.lit(CLOSE)).alias("segment"), F.length(head).cast("long").alias("head"), "text", "loose", mine.cast("int").alias("mask"))
    x = x.withColumn("n", F.length("segment").cast("long"))
    group = ["conv_id", "perspective"]
    totals = x.groupBy(*group, "block").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*(F.col(c).alias(f"b_{c}") for c in (*group, "block")), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*group, "block").orderBy(F.col("turn").asc_nulls_first(), "loose", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("upto", F.sum("n").over(inside))
    y = x.join(base, F.col("conv_id").eqNullSafe(F.col("b_conv_id")) & (F.col("perspective") == F.col("b_perspective")) & (F.col("block") == F.col("b_block")))
    stop = F.col("base") + F.col("upto")
    return y.select("conv_id", "perspective", "turn", "speaker", "segment", (stop - F.col("n")).alias("start"), (stop - F.col("n") + F.col("head")).alias("content_start"), stop.alias("stop"), "mask")


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN coalesce(trim(role), '') = '' THEN 'unknown' ELSE trim(role) END AS role, coalesce(text, '') AS text
  FROM conversations),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
x AS (
  SELECT t.conv_id, perspective, turn, role, text,
         CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END AS speaker,
         CASE WHEN role = perspective THEN 1 ELSE 0 END AS mask
  FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
y AS (SELECT *, '<|start|>' || speaker || chr(10) AS head FROM x),
z AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM y),
s AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, CASE WHEN turn IS NULL THEN md5(role || '|' || text) END, role, text
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop
  FROM z)
SELECT conv_id, perspective, turn, speaker, segment, stop - length(segment) AS start, stop - length(segment) + length(head) AS content_start,
       stop, mask
FROM s
"""
