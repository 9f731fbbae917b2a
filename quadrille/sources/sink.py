"""GeoParquet output: distributed datasets, and single files with the geo footer key."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions.geometry import Geometry
from quadrille.operators.order import KEY, WORLD, spatially_sorted, with_key
from quadrille.sources.index import row_group_rows
from quadrille.sources.lake import listed
from quadrille.sources.shared import removed, shared_dir
from quadrille.sources.splice import splice

# The output's defaults.
COMPRESSION, LEVEL, ROW_GROUP = "zstd", 3, 100_000


def geo_metadata(bounds: tuple[float, float, float, float] | None = None, types: Sequence[str] = (), covering: bool = True) -> dict:
    """The value of the geo footer key, version 1.1.0; `covering`: whether the file has a bbox column."""
    column: dict = {"encoding": "WKB", "geometry_types": sorted(types)}
    if covering:
        column["covering"] = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    if bounds:
        column["bbox"] = list(bounds)
    return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}


def write_dataset(df: DataFrame, path: str, extent: tuple[float, float, float, float] | None = None, sort: bool = True, compression: str = COMPRESSION, level: int = LEVEL, row_group_size: int = ROW_GROUP) -> str:
    """A folder of Parquet files, written in parallel, along the curve if sorted."""
    out = spatially_sorted(df, extent or WORLD) if sort and "bbox" in df.columns else df
    _writer(out, compression, level, row_group_size).parquet(path)
    return path


def _writer(df: DataFrame, compression: str, level: int, row_group_size: int):
    return df.write.mode("overwrite").option("compression", compression).option("parquet.compression.codec.zstd.level", level).option("parquet.block.row.count.limit", row_group_size)


def write_geoparquet(df: DataFrame, path: str, extent: tuple[float, float, float, float] | None = None, sort: bool = True, compression: str = COMPRESSION, level: int = LEVEL, row_group_size: int = ROW_GROUP, columns: Sequence[str] | None = None) -> str:
    """One file on the driver's side with the geo key: row groups are written by tasks and spliced byte by byte.

    Rows go through the folder that all executors share: once in order, to be
    counted, then a row group for each task.  What is copied here is the
    groups' bytes, in steps of a fixed size.  Rows are sorted by their box, or
    by their geometry's if there is no bbox column; `columns` are those that
    are written, all by default.
    """
    spark = df.sparkSession
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    parts = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    own = f"{path}.{uuid.uuid4().hex}"
    try:
        out = df
        if sort and ("bbox" in df.columns or "geometry" in df.columns):
            out = with_key(df, extent or WORLD).repartitionByRange(KEY).sortWithinPartitions(KEY).drop(KEY)
        out = out.select(*[f"`{c}`" for c in columns]) if columns is not None else out
        out.write.parquet(f"{parts}/sorted")
        written = spark.read.schema(out.schema).parquet(f"{parts}/sorted")
        grouped, there = _in_groups(spark, written, f"{parts}/sorted", row_group_size)
        _writer(grouped, compression, level, row_group_size).parquet(f"{parts}/groups")
        store, root = fs.FileSystem.from_uri(f"{parts}/groups")
        keys = {"geo": json.dumps(_geo(written))} if "geometry" in written.columns else {}
        with open(own, "wb") as one:
            rows = splice(store, [f"{root}/{n}" for n in _in_order(spark, f"{parts}/groups")], one, keys)
        if rows != there:
            raise RuntimeError(f"{rows} of {there} rows of {parts} reach the file")
        os.replace(own, path)
    finally:
        removed(spark, parts)
        if os.path.exists(own):
            os.remove(own)
    return path


def _in_order(spark: SparkSession, folder: str) -> list[str]:
    """The names of a write's files by their task's number."""
    names = [n for n, _, _ in listed(spark, folder) if n.endswith(".parquet")]
    return sorted(names, key=lambda n: int(n.split("-")[1]))


def placed(spark: SparkSession, written: DataFrame, folder: str) -> tuple[DataFrame, str, int]:
    """The rows of ordered files with their place among all as a further column; that column's name; how many rows there are."""
    names = _in_order(spark, folder)
    counted = {r.filename.rsplit("/", 1)[1]: r.rows for r in row_group_rows(spark, [f"{folder}/{n}" for n in names]).groupBy("filename").agg(F.sum("rows").alias("rows")).collect()}  # a row for each file
    before, total = [], 0
    for n in names:
        before.append((n, total))
        total += counted.get(n, 0)
    name, place = (f"{k}-{uuid.uuid4().hex}" for k in ("name", "place"))
    bases = spark.createDataFrame(before, T.StructType([T.StructField(name, T.StringType()), T.StructField(place, T.LongType())]))
    rows = written.select("*", F.col("_metadata.file_name").alias(name), F.col("_metadata.row_index").alias("row-" + place))
    return rows.join(F.broadcast(bases), name).withColumn(place, F.col(place) + F.col("row-" + place)), place, total


def _in_groups(spark: SparkSession, written: DataFrame, folder: str, size: int) -> tuple[DataFrame, int]:
    """The rows of ordered files with a partition for each row group, all full but the last; and how many rows there are."""
    rows, place, total = placed(spark, written, folder)
    groups = max(1, -(-total // size))
    dealt = rows.repartitionById(groups, F.floor(F.col(place) / F.lit(size)).cast("int")).sortWithinPartitions(place)
    return dealt.select(*[f"`{c}`" for c in written.columns]), total


#: GeoParquet's names of WKB type codes.
_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def _geo(written: DataFrame) -> dict:
    """The geo key's value: which types and which box the written rows have."""
    # Byte 1 tells the order of the four bytes of the code; thousands and high bits mark Z and M.
    code = F.expr("conv(hex(if(substring(geometry, 1, 1) = X'01', reverse(substring(geometry, 2, 4)), substring(geometry, 2, 4))), 16, 10)").cast("long")
    code = F.expr("cast(null as long)") if not isinstance(written.schema["geometry"].dataType, T.BinaryType) else code
    found = [F.collect_set(F.pmod(code.bitwiseAND(0xFFFFFFF), F.lit(1000))).alias("codes")]
    boxed = "bbox" in written.columns
    if boxed:
        found += [F.min("bbox.xmin").cast("double"), F.min("bbox.ymin").cast("double"), F.max("bbox.xmax").cast("double"), F.max("bbox.ymax").cast("double")]
    codes, *bounds = written.agg(*found).first()
    return geo_metadata(tuple(bounds) if bounds and None not in bounds else None, [_TYPES[c] for c in codes if c in _TYPES], boxed)


def to_frame(df: DataFrame):
    """A pandas frame indexed by id, its geometry as Geometry values."""
    out = df.toPandas().set_index("id")
    if "geometry" in out:
        out["geometry"] = [None if g is None else Geometry.from_wkb(bytes(g)) for g in out["geometry"]]
    return out
