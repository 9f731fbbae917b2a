"""Tokens of every document in two tokenizers, aligned."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.alignment import Alignment

NAME, SQL = "op12_token_alignment", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents()
