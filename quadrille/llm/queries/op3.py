"""Components of the documents' Jaccard join on four-word shingles."""

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.jaccard import JaccardJoin, near_components

NAME = "op3_ngram_jaccard"

JOIN = JaccardJoin(width=4, percent=85)

SQL = f"""
WITH RECURSIVE spoken AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct([array_to_string(w[i:i + {JOIN.width - 1}], ' ') FOR i IN range(1, greatest(len(w) - {JOIN.width - 2}, least(len(w), 1) + 1))]) AS s FROM spoken
), held AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {JOIN.percent} * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(b) FROM reached WHERE a = doc_id) AS component_id FROM sets
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), JOIN)
