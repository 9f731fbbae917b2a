"""SentencePiece encoding and decoding of every document."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.pieces import encoding_digests

NAME, SQL = "op1_sentencepiece", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
