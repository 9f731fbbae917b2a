"""Feature tables made of the driver's star-schema tables, which hold no geometry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def point_wkb(x: Column, y: Column) -> Column:
    """Points as little-endian WKB."""

    @F.arrow_udf("binary")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        n = len(x)
        out = np.zeros((n, 21), np.uint8)
        out[:, :5] = (1, 1, 0, 0, 0)
        out[:, 5:] = np.column_stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)]).astype("<f8").view(np.uint8).reshape(n, 16)
        return pa.array([r.tobytes() for r in out], pa.binary())

    return run(x, y)


def points(spark: SparkSession, sf_dir: str, wkb: bool = False) -> DataFrame:
    """id, lon, lat, event_type, value, bbox and, on demand, geometry: a point for each event."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"),
        F.expr("cast((user_id * 7919) % 36000 as double) / 1e2 - 180e0").alias("lon"),
        F.expr("cast((event_id * 104729) % 18000 as double) / 1e2 - 90e0").alias("lat"),
        "event_type",
        "value",
    )
    boxed = df.withColumn("bbox", F.struct(F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax")))
    return boxed.withColumn("geometry", point_wkb(F.col("lon"), F.col("lat")) if wkb else F.lit(None).cast("binary"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points widened to boxes, some of them flat."""
    p = points(spark, sf_dir)
    xmax, ymax = F.expr("lon + cast(id % 7 as double) / 1e1"), F.expr("lat + cast(id % 5 as double) / 1e1")
    return p.withColumn("bbox", F.struct(F.col("lon").alias("xmin"), xmax.alias("xmax"), F.col("lat").alias("ymin"), ymax.alias("ymax")))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, subtype, class: orders by status and priority, one priority as null."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("subtype"), F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')").alias("class"))


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (not unique), subtype, class: order lines by flag and status."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), F.col("l_returnflag").alias("subtype"), F.col("l_linestatus").alias("class"))


def place_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, categories, confidence: parts by type, with the words of their names as alternates (null for some)."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("id"),
        F.struct(F.col("p_type").alias("primary"), F.expr("case when p_size % 4 = 0 then null else split(p_name, ' ') end").alias("alternate")).alias("categories"),
        F.expr("cast(p_size as double) / 5e1").alias("confidence"),
    )


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, bbox: a box for each supplier, and a wide one for each nation (ids below 0)."""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS id", "cast((s_suppkey * 7919) % 360 - 180 AS double) AS x", "cast((s_suppkey * 104729) % 180 - 90 AS double) AS y", "cast(s_suppkey % 7 AS double) AS w", "cast(s_suppkey % 5 AS double) AS h")
    wide = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("-1 - n_nationkey AS id", "cast(n_nationkey * 13 - 180 AS double) AS x", "cast(n_nationkey * 5 - 90 AS double) AS y", "40e0 AS w", "25e0 AS h")
    return own.unionByName(wide).selectExpr("cast(id AS long) AS id", "named_struct('xmin', x, 'xmax', x + w, 'ymin', y, 'ymax', y + h) AS bbox")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, bbox, geometry: the lower left half of each rectangle that is no line, as a polygon."""

    @F.arrow_udf("binary")
    def half(xmin: pa.Array, xmax: pa.Array, ymin: pa.Array, ymax: pa.Array) -> pa.Array:
        head = (1).to_bytes(1, "little") + b"".join(v.to_bytes(4, "little") for v in (3, 1, 4))
        return pa.array([head + np.array([a, c, b, c, a, d, a, c], "<f8").tobytes() for a, b, c, d in zip(*(v.to_pylist() for v in (xmin, xmax, ymin, ymax)), strict=True)], pa.binary())

    df = rectangles(spark, sf_dir).where("bbox.xmax > bbox.xmin AND bbox.ymax > bbox.ymin")
    return df.withColumn("geometry", half(*[F.col(f"bbox.{k}") for k in ("xmin", "xmax", "ymin", "ymax")]))
