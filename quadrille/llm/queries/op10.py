"""Token-id files of every document, read back."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.tokenfiles import read_token_files, write_token_files
from quadrille.llm.workspace import shared_dir

NAME, SQL = "op10_token_files", None

END_ID = 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, END_ID)
    return read_token_files(spark, folder, with_ids=False)
