"""Base figures and quality verdict of every document."""

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.quality import learn, score, usable_labels

NAME, SQL = "op8_quality_rules", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable_labels())
    return score(docs, model)
