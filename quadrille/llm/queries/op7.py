"""The main text of every page."""

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.htmltext import extract

NAME, SQL = "op7_html_extraction", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
