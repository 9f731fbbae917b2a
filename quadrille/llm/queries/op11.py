"""Groups of equal texts of the whole table."""

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.recipes import exact_groups

NAME = "op11_exact_dedup"

SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), groups AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM texts JOIN groups USING (t)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chunks")
