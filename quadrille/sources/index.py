"""The row-group index of a release: which box each row group of each file covers.

Footers are read where the executors run, a file at a time; the result is one
small table a theme and type, stored along the curve, and a catalog of their
checksums.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.geometry import Geometry
from quadrille.functions.intersects import st_intersects
from quadrille.operators.extract import touches_box
from quadrille.operators.order import WORLD, spatially_sorted
from quadrille.sources.lake import Lake, listed
from quadrille.sources.shared import removed

SCHEMA = "filename string, row_group int, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, geometry binary"
CATALOG = "release_index_content.json"


def _spread(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.createDataFrame(spark.sparkContext.parallelize([(f,) for f in files], max(1, min(len(files), 1000))), "filename string")


def _metadata(name: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(name) if ":" in name.split("/")[0] else (fs.LocalFileSystem(), name)
    with store.open_input_file(path) as f:
        return pq.read_metadata(f)


def row_group_counts(spark: SparkSession, files: list[str]) -> DataFrame:
    """filename, row_groups, from the footers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"filename": b.filename, "row_groups": [_metadata(f).num_row_groups for f in b.filename]})

    return _spread(spark, files).mapInPandas(run, "filename string, row_groups int")


def row_group_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """filename, row_group, rows, from the footers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            metas = [(name, _metadata(name)) for name in b.filename]
            yield pd.DataFrame([(name, g, m.row_group(g).num_rows) for name, m in metas for g in range(m.num_row_groups)], columns=["filename", "row_group", "rows"])

    return _spread(spark, files).mapInPandas(run, "filename string, row_group int, rows long")


def footer_boxes(spark: SparkSession, files: list[str]) -> DataFrame:
    """filename, row_group, bbox, geometry: each row group's box by the footer's minima and maxima; null where the footer has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name in b.filename:
                meta = _metadata(name)
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    stats = {c.path_in_schema: c.statistics for c in map(group.column, range(group.num_columns)) if c.statistics is not None and c.statistics.has_min_max}
                    if any(f"bbox.{k}" not in stats for k in ("xmin", "xmax", "ymin", "ymax")):
                        rows.append((name, g, None, None))
                        continue
                    box = {k: float(getattr(stats[f"bbox.{k}"], k[1:])) for k in ("xmin", "xmax", "ymin", "ymax")}
                    rows.append((name, g, box, Geometry.box(box["xmin"], box["ymin"], box["xmax"], box["ymax"]).to_wkb()))
            yield pd.DataFrame(rows, columns=["filename", "row_group", "bbox", "geometry"])

    return _spread(spark, files).mapInPandas(run, SCHEMA)


def digest(spark: SparkSession, folder: str) -> str:
    """sha256 over the sha256 of the bytes of each of a folder's Parquet files, in order of name: an index has few."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    each = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).collect()
    return hashlib.sha256("\n".join(f"{r.name} {r.sha}" for r in sorted(each)).encode()).hexdigest()


#: Level at which the index is compressed: it is written once and read often.
INDEX_LEVEL = 22


def generate_release_index(lake: Lake, target: str, release: str | None = None, ignore_cache: bool = False, pairs: Sequence[tuple[str, str]] | None = None) -> bool:
    """Writes the index of a release (or of some of its tables) under `target`; False if it was there already.

    Some tables alone get a catalog of their own, which merged_catalog joins to the release's.
    """
    spark, release = lake.spark, lake.resolved(release)
    base = f"{target}/{release}"
    name = CATALOG if pairs is None else "_".join(["part", *("-".join(p) for p in pairs)]) + ".json"
    if not ignore_cache and any(n in (CATALOG, name) for n, _, _ in listed(spark, base)):
        return False
    content = []
    for theme, type_ in lake.pairs(release) if pairs is None else pairs:
        folder = f"{base}/{theme}_{type_}.parquet"
        boxes = footer_boxes(spark, lake.files(theme, type_, release))
        spatially_sorted(boxes, WORLD).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", INDEX_LEVEL).parquet(folder)
        content.append({"theme": theme, "type": type_, "sha": digest(spark, folder)})
    _write_text(spark, f"{base}/{name}", json.dumps(content))
    return True


def merged_catalog(spark: SparkSession, target: str, release: str, remove: bool = False) -> bool:
    """Joins the catalogs of some tables to the release's catalog; False if that is there already."""
    base = f"{target}/{release}"
    names = [n for n, folder, _ in listed(spark, base) if not folder and n.endswith(".json")]
    if CATALOG in names:
        return False
    parts = [json.loads("".join(r[0] for r in spark.read.text(f"{base}/{n}").collect())) for n in names]
    _write_text(spark, f"{base}/{CATALOG}", json.dumps([entry for part in parts for entry in part]))
    if remove:
        for n in names:
            removed(spark, f"{base}/{n}")
    return True


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def catalog(spark: SparkSession, target: str, release: str) -> list[dict]:
    """theme, type and checksum of each table of an index."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{target}/{release}/{CATALOG}").collect()))


def download_existing_release_index(spark: SparkSession, target: str, release: str, only: tuple[str, str] | None = None) -> bool:
    """Whether a local index of the release is there and whole (or one table of it); a changed table raises."""
    if not any(n == CATALOG for n, _, _ in listed(spark, f"{target}/{release}")):
        return False
    for entry in catalog(spark, target, release):
        if only in (None, (entry["theme"], entry["type"])) and digest(spark, f"{target}/{release}/{entry['theme']}_{entry['type']}.parquet") != entry["sha"]:
            raise ValueError(f"checksum of {entry['theme']}/{entry['type']} differs")
    return True


def load_release_index(lake: Lake, target: str, theme: str, type_: str, release: str | None = None, region: Geometry | None = None, remote_index: bool = False, skip_index_download: bool = False) -> DataFrame:
    """The row groups of a table by file and number, those that meet the region (closed) or have no box if one is given.

    The index is taken as it lies under `target` if its checksums are right, else made; skip_index_download makes it without that look.
    """
    if remote_index:
        raise NotImplementedError("a remote index needs a network")
    release = lake.resolved(release)
    if skip_index_download or not download_existing_release_index(lake.spark, target, release, (theme, type_)):
        generate_release_index(lake, target, release)
    df = lake.spark.read.parquet(f"{target}/{release}/{theme}_{type_}.parquet")
    if region is not None:
        df = df.where(F.col("bbox").isNull() | touches_box(region.bounds))
        if not region.is_rectangle:
            df = df.where(F.col("bbox").isNull() | st_intersects(F.col("geometry"), region))
    return df.orderBy("filename", "row_group")


def load_release_indexes(lake: Lake, target: str, pairs: list[tuple[str, str]], release: str | None = None, region: Geometry | None = None) -> DataFrame:
    """The row groups of several tables, with their theme and type."""
    parts = [load_release_index(lake, target, t, u, release, region).select(F.lit(t).alias("theme"), F.lit(u).alias("type"), "*") for t, u in pairs]
    return reduce(DataFrame.unionByName, parts)


def pruned_files(index: DataFrame) -> list[str]:
    """The files that an index's row groups lie in: at most as many as the table has."""
    return sorted(r[0] for r in index.select("filename").distinct().collect())
