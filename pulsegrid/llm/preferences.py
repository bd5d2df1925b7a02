"""Preference pairs: the turns two conversations share are rendered once, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, stored

FIRST_TURN = -(1 << 63)   # where a turn without a number is put


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _turns(side: DataFrame) -> DataFrame:
    """Distinct rows of a side, with `n` numbering different rows of one turn by role and text."""
    rows = columns_of(side, "pair_id", "turn", "role", "text").select(
        F.col("pair_id").cast("bigint"), F.coalesce(F.col("turn").cast("bigint"), F.lit(FIRST_TURN)).alias("turn"), "role", "text").distinct()
    order = Window.partitionBy("pair_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.withColumn("n", F.row_number().over(order))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per turn of a segment: pair_id, segment, turn, n, role, text, trains.

    Both sides have pair_id, turn, role, text. The prompt is the longest run of first turns that both sides have alike; it is
    rendered once, from the chosen side. Segments `chosen` and `rejected` hold what follows; `trains` is true for their
    assistant turns and false elsewhere, the prompt included. Equal sides are all prompt; a side that ends first has no
    completion; a pair with one side only has no prompt. Rows that repeat are one turn; turns without a number come first;
    rows without pair_id form one pair. Turns stay rows, so a conversation of any length is never one value.
    """
    left, right = _turns(chosen), _turns(rejected)
    both = left.alias("c").join(right.alias("r"), F.col("c.pair_id").eqNullSafe(F.col("r.pair_id"))
                                & (F.col("c.turn") == F.col("r.turn")) & (F.col("c.n") == F.col("r.n")), "full")
    same = F.col("c.n").isNotNull() & F.col("r.n").isNotNull() & F.col("c.role").eqNullSafe(F.col("r.role")) & F.col("c.text").eqNullSafe(F.col("r.text"))
    rows = stored(both.select(F.coalesce("c.pair_id", "r.pair_id").alias("pair_id"), F.coalesce("c.turn", "r.turn").alias("turn"),
                              F.coalesce("c.n", "r.n").alias("n"), same.alias("same"), F.col("c.n").isNotNull().alias("in_c"),
                              F.col("r.n").isNotNull().alias("in_r"), F.col("c.role").alias("c_role"), F.col("c.text").alias("c_text"),
                              F.col("r.role").alias("r_role"), F.col("r.text").alias("r_text")), "turns")
    # One row per pair; stored, so that the join may split a pair that holds much of the table.
    parting = stored(rows.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("parting")), "parting")
    joined = rows.alias("t").join(parting.alias("p"), F.col("t.pair_id").eqNullSafe(F.col("p.pair_id"))).select("t.*", "p.parting")
    prompt = F.col("parting").isNull() | (F.col("turn") < F.col("parting"))
    part = lambda name, side: F.struct(F.lit(name).alias("segment"), F.col(f"{side}_role").alias("role"), F.col(f"{side}_text").alias("text"))
    parts = F.when(prompt, F.array(part("prompt", "c"))).otherwise(F.filter(
        F.array(F.when(F.col("in_c"), part("chosen", "c")), F.when(F.col("in_r"), part("rejected", "r"))), lambda x: x.isNotNull()))
    out = joined.select("pair_id", "turn", "n", F.explode(parts).alias("s"))
    trains = (F.col("s.segment") != "prompt") & (F.coalesce(F.col("s.role"), F.lit("")) == "assistant")
    return out.select("pair_id", F.col("s.segment").alias("segment"), "turn", "n", F.col("s.role").alias("role"),
                      rendered(F.col("s.role"), F.col("s.text")).alias("text"), trains.alias("trains"))


def echo_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) from whole conversations: the rejected side answers the last time with the turn before it.

    Every conversation is a chosen side. In its rejected copy the last assistant turn echoes the text of the turn numbered one
    less (the greatest by code point if there are several, empty if there is none). Conversations without an assistant stay alike.
    """
    chosen = columns_of(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("bigint").alias("pair_id"), F.col("turn").cast("bigint"), "role", "text")
    last = stored(chosen.where("role = 'assistant' AND turn IS NOT NULL").groupBy("pair_id").agg(F.max("turn").alias("last")), "last")
    one = chosen.alias("t").join(last.alias("l"), F.col("t.pair_id").eqNullSafe(F.col("l.pair_id")), "left").select("t.*", "l.last")
    echo = stored(one.where(F.col("turn") == F.col("last") - 1).groupBy("pair_id").agg(F.max("text").alias("echo")), "echo")
    answers = (F.col("o.role") == "assistant") & (F.col("o.turn") == F.col("o.last"))
    rejected = one.alias("o").join(echo.alias("e"), F.col("o.pair_id").eqNullSafe(F.col("e.pair_id")), "left").select(
        "o.pair_id", "o.turn", "o.role", F.when(answers, F.coalesce("e.echo", F.lit(""))).otherwise(F.col("o.text")).alias("text"))
    return chosen, rejected


ORACLE = """
WITH c AS (SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations),
l AS (SELECT pair_id, max(turn) AS last FROM c WHERE role = 'assistant' GROUP BY pair_id),
e AS (SELECT pair_id, max(text) AS echo FROM c JOIN l USING (pair_id) WHERE turn = last - 1 GROUP BY pair_id),
j AS (SELECT DISTINCT c.pair_id, turn, role, CASE WHEN role = 'assistant' AND turn = last THEN coalesce(echo, '') ELSE text END AS text
      FROM c LEFT JOIN l USING (pair_id) LEFT JOIN e USING (pair_id)),
cn AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS n FROM c),
jn AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS n FROM j),
b AS (SELECT coalesce(cn.pair_id, jn.pair_id) AS pair_id, coalesce(cn.turn, jn.turn) AS turn, coalesce(cn.n, jn.n)::int AS n,
             cn.n IS NOT NULL AS in_c, jn.n IS NOT NULL AS in_r, cn.role AS c_role, cn.text AS c_text, jn.role AS r_role, jn.text AS r_text,
             cn.n IS NOT NULL AND jn.n IS NOT NULL AND cn.role IS NOT DISTINCT FROM jn.role AND cn.text IS NOT DISTINCT FROM jn.text AS same
      FROM cn FULL JOIN jn ON cn.pair_id = jn.pair_id AND cn.turn = jn.turn AND cn.n = jn.n),
p AS (SELECT *, min(CASE WHEN NOT same THEN turn END) OVER (PARTITION BY pair_id) AS parting FROM b),
s AS (SELECT pair_id, 'prompt' AS segment, turn, n, c_role AS role, c_text AS body FROM p WHERE parting IS NULL OR turn < parting
      UNION ALL SELECT pair_id, 'chosen', turn, n, c_role, c_text FROM p WHERE turn >= parting AND in_c
      UNION ALL SELECT pair_id, 'rejected', turn, n, r_role, r_text FROM p WHERE turn >= parting AND in_r)
SELECT pair_id, segment, turn, n, role, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(body, '') || '<|end|>' || chr(10) AS text,
       segment <> 'prompt' AND coalesce(role, '') = 'assistant' AS trains FROM s"""
