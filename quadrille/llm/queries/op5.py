"""The language of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.langid import identify, learn
from quadrille.llm.learning import held_out

NAME, SQL = "op5_language_id", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
