"""Where the documents hold items of the benchmark."""

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.decontaminate import find_items

NAME, SQL = "op4_decontamination", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
