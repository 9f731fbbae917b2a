"""Ordering of features along a Hilbert curve."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import Geometry
from quadrille.functions.hilbert import hilbert_key

WORLD = (-180.0, -90.0, 180.0, 90.0)
KEY = "_curve"


def geometry_box(geometry: Column) -> Column:
    """The box of each WKB value; null for null and empty ones."""

    @F.arrow_udf("struct<xmin:double,xmax:double,ymin:double,ymax:double>")
    def run(values: pa.Array) -> pa.Array:
        found = [None if v is None or (g := Geometry.from_wkb(v)).empty else g.bounds for v in values.to_pylist()]
        return pa.array([None if b is None else {"xmin": b[0], "xmax": b[2], "ymin": b[1], "ymax": b[3]} for b in found], pa.struct([(k, pa.float64()) for k in ("xmin", "xmax", "ymin", "ymax")]))

    return run(geometry)


def with_key(df: DataFrame, extent: tuple[float, float, float, float] = WORLD, bbox: str = "bbox") -> DataFrame:
    """The curve position of each row's box centre as column KEY; without a box column, of its geometry's box."""
    if bbox not in df.columns:
        return with_key(df.withColumn(bbox, geometry_box(F.col("geometry"))), extent, bbox).drop(bbox)
    side = lambda name: F.col(f"{bbox}.{name}").cast("double")
    return df.withColumn(KEY, hilbert_key((side("xmin") + side("xmax")) / 2, (side("ymin") + side("ymax")) / 2, extent))


def spatially_sorted(df: DataFrame, extent: tuple[float, float, float, float] = WORLD, bbox: str = "bbox") -> DataFrame:
    """Ranges of the curve to partitions, each sorted: the files of a dataset follow the curve, without one global sort task."""
    keyed = with_key(df, extent, bbox)
    return keyed.repartitionByRange(KEY).sortWithinPartitions(KEY).drop(KEY)
