"""Category taxonomies: `category;[a,b,c]` lines under a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 6


def read_taxonomy(spark: SparkSession, path: str, levels: int = LEVELS) -> DataFrame:
    """category and its levels as columns "1" to "6", null below the path's end; level names are not trimmed."""
    raw = spark.read.csv(path, sep=";", header=True, schema="category string, hierarchy string")
    return split_paths(raw, levels)


def split_paths(raw: DataFrame, levels: int = LEVELS) -> DataFrame:
    """category and levels from (category, hierarchy)."""
    inner = F.regexp_replace(F.trim("hierarchy"), r"^\[|\]$", "")
    path = F.split(inner, ",")
    return raw.select(F.trim("category").alias("category"), *[F.get(path, F.lit(i)).alias(str(i + 1)) for i in range(levels)])
