"""Preference formatting: the shared turns of a chosen and a rejected conversation once, and both masked rests.

DataFrame functions only. One shuffle by pair gathers each pair's turns, which the result needs together anyway;
all else happens within the row. The query makes a pair of each conversation: as it is, and with its last answer
exchanged for that of its neighbour.

Rows: null roles and texts count as empty; a null turn comes first and rows with equal turns are ordered by role and
text, repeated rows staying; very long texts are rendered whole; turns without pair_id (conv_id) belong to no pair and are
left out; a pair without one side has an empty prefix and an empty rest there; conversations that
are equal have all turns in the prompt; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _mask(turn: Column) -> Column:
    """Run lengths in characters with 1 where the loss counts: a turn's head never, its body in assistant turns."""
    trained = F.when(turn["role"] == "assistant", F.lit(":1")).otherwise(F.lit(":0"))
    return F.concat((F.length(turn["role"]) + 5).cast("string"), F.lit(":0,"), (F.length(turn["text"]) + 8).cast("string"), trained)


def preferences(turns: DataFrame) -> DataFrame:
    """``turns`` has pair_id, side (``chosen`` or ``rejected``), turn, role and text.

    Returns pair_id, n_shared, prompt, chosen, rejected, chosen_mask and rejected_mask.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = [F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected")]
    pairs = turns.where("pair_id is not null").groupBy("pair_id").agg(*sides)
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differ = F.array_position(same, False)
    pairs = pairs.withColumn("n_shared", F.when(differ == 0, F.size("chosen").cast("long")).otherwise(differ - 1))
    rest = {s: F.slice(s, F.col("n_shared").cast("int") + 1, F.greatest(F.size(s), F.lit(1))) for s in ("chosen", "rejected")}
    return pairs.select(
        "pair_id",
        "n_shared",
        F.array_join(F.transform(F.slice("chosen", 1, F.col("n_shared").cast("int")), _render), "").alias("prompt"),
        *[F.array_join(F.transform(rest[s], _render), "").alias(s) for s in rest],
        *[F.array_join(F.transform(rest[s], _mask), ",").alias(f"{s}_mask") for s in rest],
    )


def alternatives(conversations: DataFrame) -> DataFrame:
    """Each conversation as chosen, and as rejected with the last answer of its neighbour (2k of 2k + 1 and the other way about)
    in place of its own last answer and all after it. Without a neighbour the rejected side ends before the answer; without
    an answer both sides are equal."""
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    answers = turns.where("role = 'assistant' and turn is not null").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    own = answers.select("conv_id", F.col("last.turn").alias("last_turn"))
    other = answers.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("text"))
    before = turns.join(own, "conv_id", "left").where("last_turn is null or turn is null or turn < last_turn")
    return (
        turns.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
        .unionByName(before.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text"))
        .unionByName(own.join(other, "conv_id").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), "text"))
    )


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(alternatives(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql_side(side: str) -> str:
    rest = f"list_slice({side}, n_shared + 1, len({side}))"
    render = "'<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)"
    mask = "(length(t.role) + 5) || ':0,' || (length(t.text) + 8) || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END"
    return f"array_to_string(list_transform({rest}, lambda t: {render}), '') AS {side}, array_to_string(list_transform({rest}, lambda t: {mask}), ',') AS {side}_mask"


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
answers AS (
  SELECT conv_id, max(turn) AS last_turn, max({{'turn': turn, 'text': text}}).text AS answer
  FROM turns WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id),
sides AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM turns
  UNION ALL
  SELECT t.conv_id, 1, turn, role, text FROM turns t LEFT JOIN answers a ON a.conv_id = t.conv_id WHERE last_turn IS NULL OR turn IS NULL OR turn < last_turn
  UNION ALL
  SELECT a.conv_id, 1, a.last_turn, 'assistant', b.answer FROM answers a JOIN answers b ON b.conv_id = xor(a.conv_id, 1)),
pairs AS (
  SELECT pair_id, coalesce(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) FILTER (side = 0), []) AS chosen,
         coalesce(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) FILTER (side = 1), []) AS rejected FROM sides GROUP BY pair_id),
compared AS (
  SELECT *, list_position(list_transform(range(1, greatest(len(chosen), len(rejected)) + 1),
    lambda i: coalesce(chosen[i].role = rejected[i].role AND chosen[i].text = rejected[i].text, false)), false) AS differ FROM pairs),
counted AS (SELECT *, CAST(CASE WHEN coalesce(differ, 0) = 0 THEN len(chosen) ELSE differ - 1 END AS BIGINT) AS n_shared FROM compared)
SELECT pair_id, n_shared,
  array_to_string(list_transform(list_slice(chosen, 1, n_shared), lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS prompt,
  {_sql_side("chosen")}, {_sql_side("rejected")}
FROM counted
"""
