"""Preference pairs of neighbouring conversations: 2k is chosen over 2k + 1.

The tables hold no judgements, so ids make the pairs.  A conversation without
a neighbour is a pair with an empty side.  Masks are given as text, begin-end
with commas between.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.chat import preference_pairs

NAME = "op9_chat_formatting"


def _sql_text(turns: str) -> str:
    return f"array_to_string(['<|' || x.role || chr(124) || '>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN {turns}], '')"


def _sql_mask(turns: str) -> str:
    before = f"coalesce(list_sum([length(y.role) + length(y.text) + 13 FOR y IN {turns}[1:i - 1]]), 0)::BIGINT"
    begin = f"({before} + length({turns}[i].role) + 5)"
    return f"array_to_string([{begin} || '-' || ({begin} + length({turns}[i].text) + 8) FOR i IN range(1, len({turns}) + 1) IF {turns}[i].role = 'assistant'], ',')"


SQL = f"""
WITH whole AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), pairs AS (
  SELECT DISTINCT (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id FROM whole
), sides AS (
  SELECT pair_id, 2 * pair_id AS chosen_id, 2 * pair_id + 1 AS rejected_id, coalesce(a.turns, []) AS c, coalesce(b.turns, []) AS r
  FROM pairs LEFT JOIN whole a ON a.conv_id = 2 * pair_id LEFT JOIN whole b ON b.conv_id = 2 * pair_id + 1
), agreed AS (
  SELECT *, [coalesce(c[i].role = r[i].role AND c[i].text = r[i].text, FALSE) FOR i IN range(1, greatest(len(c), len(r)) + 1)] AS same FROM sides
), cut AS (
  SELECT *, coalesce(nullif(list_position(same, FALSE), 0) - 1, len(same))::INTEGER AS n_common FROM agreed
), parts AS (
  SELECT pair_id, chosen_id, rejected_id, n_common, c[1:n_common] AS p, c[n_common + 1:] AS c, r[n_common + 1:] AS r FROM cut
)
SELECT pair_id, chosen_id, rejected_id, n_common, {_sql_text('p')} AS prompt, {_sql_text('c')} AS chosen, {_sql_text('r')} AS rejected,
  {_sql_mask('c')} AS chosen_mask, {_sql_mask('r')} AS rejected_mask
FROM parts
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = turns.filter(F.col("conv_id").isNotNull()).select(F.shiftright("conv_id", 1).alias("pair_id")).distinct().select("pair_id", (2 * F.col("pair_id")).alias("chosen_id"), (2 * F.col("pair_id") + 1).alias("rejected_id"))
    shown = {m: F.array_join(F.transform(m, lambda s: F.concat(s.begin.cast("string"), F.lit("-"), s.end.cast("string"))), ",") for m in ("chosen_mask", "rejected_mask")}
    return preference_pairs(turns, pairs).withColumns(shown)
