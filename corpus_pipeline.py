"""The corpus pipeline: STAGES over `documents`, each written as Parquet and read again by the next.

    run(spark, sf_dir)   the rows of the last stage

Every stage works on all rows that its predecessor kept.  All but the last
return the columns of `documents`; the last returns the token ids with the
byte span of each.  Ids may be of any type that has an order; texts and
numbers beyond 64 bits stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import quality, toxicity
from quadrille.llm.decontaminate import item_count
from quadrille.llm.jaccard import JaccardJoin, near_components
from quadrille.llm.learning import held_out
from quadrille.llm.pieces import encode_documents
from quadrille.llm.workspace import modest_batches, stored, whole_ids

#: Near duplicates share 80 of 100 of their five-word shingles.
NEAR = JaccardJoin(width=5, percent=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, which learns from the labelled of them."""
    modest_batches(spark)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.usable_labels())
    return docs.filter(quality.passes(docs["text"], model))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted clean; learned from all labelled documents, whatever the stages before kept of them."""
    modest_batches(spark)
    model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    return docs.filter(~toxicity.is_toxic(docs["text"], model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id; rows without doc_id stay."""
    modest_batches(spark)
    if not whole_ids(docs) or not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _one_each(docs)
    found = near_components(docs, NEAR)
    others = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def _one_each(docs: DataFrame) -> DataFrame:
    """The same where a doc_id repeats or is no whole number: rows are told apart by an id of their own, so texts are compared whatever their doc_id."""
    # Stored, as the numbers hold for one reading only.
    rows = stored(docs.filter("doc_id IS NOT NULL").withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_components(rows.select(F.col("_row").alias("doc_id"), "text"), NEAR)
    placed = rows.select("_row", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest")).join(found.withColumnRenamed("doc_id", "_row").drop("n_shingles"), "_row")
    # A row is kept if it is the first of its component, and of the rows equal in id and text: those without words link to nothing.
    first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", "_row")).alias("one"))
    first = first.groupBy("one.doc_id", "one.digest").agg(F.min("one._row").alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    modest_batches(spark)
    return docs.filter(item_count(docs["text"], spark.read.parquet(f"{sf_dir}/benchmark.parquet")) == 0)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, begins, ends."""
    modest_batches(spark)
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_rules),
    ("toxicity", toxicity_filter),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the trained classifiers of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
