"""Registered queries that write a lake, its indexes and result files into the shared folder, and read them back.

Orders, order lines and parts become features with a point each.  A table's rows
are in order of x, y and id, a run of files for each quarter of longitudes: so
SQL can tell quarters and their row groups, and no file or task holds more than
PER_FILE row groups.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import re
import tempfile
import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import api, cli
from quadrille.catalogue import BOX, FLAGS, LINE_STATUSES, LINES, ORDERS, PLACES, PRIORITIES, STATUSES, TAXONOMY, TRIANGLE, TYPES, WORDS, _half_planes, _name, _place_names, _register, _strict, _wide_sql
from quadrille.functions.geometry import Geometry
from quadrille.functions.hilbert import curve_position, hilbert_key
from quadrille.operators import wide as W
from quadrille.operators.extract import extract
from quadrille.operators.order import WORLD
from quadrille.sources import fixtures as fx
from quadrille.sources import index, names, regions
from quadrille.sources.grouped import grouped_extract
from quadrille.sources.lake import Lake
from quadrille.sources.rowgroups import map_parquet_dataset, row_group_scan
from quadrille.sources.shared import made_folder, removed, shared_dir
from quadrille.sources.sink import placed, write_dataset
from quadrille.streaming.stateless import extract_stream, feature_stream

RELEASE = "2024-09-18.0"
WATER, LAND, PLACE = ("base", "water"), ("base", "land_use"), ("places", "place")
#: Rows in a row group of the lake, and quarters of longitudes that a table's files are dealt by.
GROUP, FILES = 2_000, 4
#: Row groups in a file: a quarter has as many files as that takes.
PER_FILE = 100


def _sql_point(id_: str) -> str:
    return f"cast(({id_} * 7919) % 36000 AS double) / 1e2 - 180e0 AS lon, cast(({id_} * 104729) % 18000 AS double) / 1e2 - 90e0 AS lat"


ORDER_POINTS = f"SELECT *, {_sql_point('id')} FROM ({ORDERS})"
LINE_POINTS = f"SELECT *, {_sql_point('id')} FROM ({LINES})"
PLACE_POINTS = f"SELECT *, {_sql_point('id')} FROM ({PLACES})"
TABLES = {WATER: ORDER_POINTS, LAND: LINE_POINTS, PLACE: PLACE_POINTS}
IN_BOX = _strict(BOX)


def _grouped(points: str) -> str:
    """The rows with their file's number and their row group there."""
    return f"SELECT *, ((row_number() OVER (PARTITION BY part ORDER BY lon, lat, id) - 1) // {GROUP})::INTEGER AS row_group FROM (SELECT *, floor((lon + 180) / {360 // FILES})::INTEGER AS part FROM ({points}))"


def _located(df: DataFrame) -> DataFrame:
    """Features with a point made of their id."""
    x, y = F.expr("cast((id * 7919) % 36000 as double) / 1e2 - 180e0"), F.expr("cast((id * 104729) % 18000 as double) / 1e2 - 90e0")
    box = F.struct(x.alias("xmin"), x.alias("xmax"), y.alias("ymin"), y.alias("ymax"))
    return df.withColumn("bbox", box).withColumn("geometry", fx.point_wkb(x, y))


#: The number of a file in its table.
_NUMBER = r"part-(\d+)[^/]*$"


@dataclass(frozen=True)
class QuarterLake(Lake):
    """A lake whose tables have a run of files for each quarter; `strides`: how many file numbers a quarter of a table has."""

    strides: dict[tuple[str, str], int] = field(default_factory=dict, compare=False)

    def numbered(self, rows: DataFrame, pair: tuple[str, str], filename: str = "filename") -> DataFrame:
        """The quarter as column part, and row_group as the group's number among those of the quarter's files."""
        number, stride = F.regexp_extract(filename, _NUMBER, 1).cast("int"), self.strides[pair]
        place = F.col("row_group") + number % stride * PER_FILE
        return rows.withColumns({"part": F.floor(number / stride).cast("int"), "row_group": place.cast("int")})


def _lake(spark: SparkSession, sf: str, *pairs: tuple[str, str]) -> QuarterLake:
    """A lake of one release with these tables."""
    lake = QuarterLake(spark, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}")
    source = {WATER: fx.order_features, LAND: fx.line_features, PLACE: fx.place_features}
    for pair in pairs:
        lake.strides[pair] = _written(spark, source[pair](spark, sf), lake.folder(*pair, RELEASE))
    return lake


def _written(spark: SparkSession, features: DataFrame, folder: str) -> int:
    """Writes a table of the lake; how many file numbers a quarter has.

    Tasks sort ranges of the order, whose files' lengths then place every row
    among its quarter's; a task for each file takes its places.
    """
    rows = _located(features).drop("geometry")
    quarter = F.floor((F.col("bbox.xmin") + 180) / (360 // FILES)).cast("int")
    counts = {r.part: r.n for r in rows.groupBy(quarter.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each quarter
    full, order = GROUP * PER_FILE, ("bbox.xmin", "bbox.ymin", "id")
    ranges, stride = (max(1, -(-n // full)) for n in (sum(counts.values()), max(counts.values(), default=0)))
    ordered = f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}"
    rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.parquet(ordered)
    written, place, _ = placed(spark, spark.read.schema(rows.schema).parquet(ordered), ordered)
    before = F.lit(0)  # rows of the quarters before
    for part in range(1, FILES):
        before = F.when(quarter >= part, F.lit(sum(counts.get(p, 0) for p in range(part)))).otherwise(before)
    number = quarter * stride + F.floor((F.col(place) - before) / full)
    dealt = written.repartitionById(FILES * stride, number.cast("int")).sortWithinPartitions(place).select(*rows.columns)
    # Points again from the box: so they are made once, not for each look at the order.
    write_dataset(dealt.withColumn("geometry", fx.point_wkb(F.col("bbox.xmin"), F.col("bbox.ymin"))), folder, sort=False, row_group_size=GROUP)
    removed(spark, ordered)
    return stride


def _configured(spark: SparkSession, sf: str, *pairs: tuple[str, str], taxonomy: bool = False) -> QuarterLake:
    """The lake, which api's calls then work on, with an index."""
    lake = _lake(spark, sf, *pairs)
    file = f"{lake.root}-taxonomy"
    if taxonomy:
        spark.createDataFrame([(f"{c};{p}",) for c, p in [("category", "hierarchy"), *TAXONOMY]], "value string").coalesce(1).write.text(file)
    api.configure(spark, lake.root, f"{lake.root}-index", file if taxonomy else None)
    return lake


def _local(path) -> pa.Table:
    """A result file on the driver's side, without the struct and WKB columns."""
    table = pq.ParquetFile(path).read()
    return table.select([c for c in table.column_names if c not in ("geometry", "bbox", "categories")])


@_register("lake_pairs", " UNION ALL ".join(f"SELECT '{RELEASE}' AS release, '{t}' AS theme, '{u}' AS type, count(*) AS n FROM ({sql})" for (t, u), sql in TABLES.items()))
def _(spark, sf):
    lake = _lake(spark, sf, *TABLES)
    counted = [(r, t, u, index.row_group_rows(spark, lake.files(t, u, r)).agg(F.sum("rows")).first()[0] or 0) for r in lake.releases() for t, u in lake.pairs(r)]
    return spark.createDataFrame(counted, "release string, theme string, type string, n long")


@_register("index_row_groups", f"SELECT row_group, count(*) AS n, min(lon) AS xmin, max(lon) AS xmax, min(lat) AS ymin, max(lat) AS ymax FROM ({_grouped(ORDER_POINTS)}) GROUP BY part, row_group")
def _(spark, sf):
    lake = _lake(spark, sf, WATER)
    found = index.load_release_index(lake, f"{lake.root}-index", *WATER, RELEASE)
    rows = index.row_group_rows(spark, lake.files(*WATER, RELEASE))
    return lake.numbered(found.join(rows, ["filename", "row_group"]), WATER).select("row_group", F.col("rows").alias("n"), "bbox.xmin", "bbox.xmax", "bbox.ymin", "bbox.ymax")


@_register("index_in_order", f"SELECT (row_number() OVER (ORDER BY part, row_group) - 1)::INTEGER AS place, row_group FROM ({_grouped(LINE_POINTS)}) GROUP BY part, row_group")
def _(spark, sf):
    """The index's rows as it gives them: by file and row group, though stored along the curve."""
    lake = _lake(spark, sf, LAND)
    given = lake.numbered(index.load_release_index(lake, f"{lake.root}-index", *LAND, RELEASE), LAND).select("row_group")
    return spark.createDataFrame(given.rdd.zipWithIndex().map(lambda r: (r[1], r[0].row_group)), "place int, row_group int")


_PRUNED = Geometry.box(-60, -30, 0, 30)


@_register("index_pruned_groups", f"SELECT row_group FROM ({_grouped(LINE_POINTS)}) GROUP BY part, row_group HAVING min(lon) <= 0 AND max(lon) >= -60 AND min(lat) <= 30 AND max(lat) >= -30")
def _(spark, sf):
    lake = _lake(spark, sf, LAND)
    return lake.numbered(index.load_release_index(lake, f"{lake.root}-index", *LAND, RELEASE, _PRUNED), LAND).select("row_group")


@_register("index_of_several_tables", f"SELECT 'base' AS theme, 'water' AS type, row_group FROM ({_grouped(ORDER_POINTS)}) GROUP BY part, row_group UNION ALL SELECT 'places', 'place', row_group FROM ({_grouped(PLACE_POINTS)}) GROUP BY part, row_group")
def _(spark, sf):
    lake = _lake(spark, sf, WATER, PLACE)
    found = index.load_release_indexes(lake, f"{lake.root}-index", [WATER, PLACE], RELEASE)
    own = [lake.numbered(found.where((F.col("theme") == t) & (F.col("type") == u)), (t, u)) for t, u in (WATER, PLACE)]
    return reduce(DataFrame.unionByName, own).select("theme", "type", "row_group")


@_register("index_catalog", "SELECT * FROM (VALUES ('base', 'land_use', TRUE), ('base', 'water', TRUE)) AS v(theme, type, whole)")
def _(spark, sf):
    """Indexes made table by table, their catalogs joined, their checksums tested."""
    lake = _lake(spark, sf, WATER, LAND)
    target = f"{lake.root}-index"
    for pair in (WATER, LAND):
        index.generate_release_index(lake, target, RELEASE, pairs=[pair])
    index.merged_catalog(spark, target, RELEASE, remove=True)
    whole = index.download_existing_release_index(spark, target, RELEASE)
    return spark.createDataFrame([(e["theme"], e["type"], whole) for e in index.catalog(spark, target, RELEASE)], "theme string, type string, whole boolean")


@_register("lake_extract", f"SELECT id, class, lon FROM ({ORDER_POINTS}) WHERE {IN_BOX} AND subtype = 'F'")
def _(spark, sf):
    _configured(spark, sf, WATER)
    rows = api.features(*WATER, Geometry.box(*BOX), RELEASE, [("subtype", "=", "F")], ["class", "bbox"])
    return rows.select("id", "class", F.col("bbox.xmin").alias("lon"))


_KEPT = f"SELECT part, row_group FROM ({_grouped(ORDER_POINTS)}) GROUP BY part, row_group HAVING min(lon) <= {BOX[2]} AND max(lon) >= {BOX[0]} AND min(lat) <= {BOX[3]} AND max(lat) >= {BOX[1]}"


@_register("lake_groups_read", f"SELECT part, row_group, count(*) FILTER (WHERE {IN_BOX} AND subtype = 'F') AS n, 'id,subtype,bbox' AS columns FROM ({_grouped(ORDER_POINTS)}) JOIN ({_KEPT}) USING (part, row_group) GROUP BY part, row_group")
def _(spark, sf):
    """What an extract reads of the lake, as its tasks tell: row groups that the index keeps, columns that are needed, rows that pass."""
    lake = _lake(spark, sf, WATER)
    box, trace = Geometry.box(*BOX), f"{lake.root}-trace"
    kept = [tuple(r) for r in index.load_release_index(lake, f"{lake.root}-index", *WATER, RELEASE, box).select("filename", "row_group").collect()]
    rows = grouped_extract(lake.read(*WATER, RELEASE).drop("geometry"), kept, box, [("subtype", "=", "F")], ["subtype"], trace=made_folder(spark, trace))
    rows.select("id").write.format("noop").mode("overwrite").save()
    told = spark.read.schema("file string, row_group int, columns array<string>, rows long").json(trace)
    return lake.numbered(told, WATER, "file").select("part", "row_group", F.col("rows").alias("n"), F.array_join("columns", ",").alias("columns"))


@_register("lake_extract_polygon", f"SELECT id FROM ({LINE_POINTS}) WHERE {_strict(Geometry.polygon(TRIANGLE).bounds)} AND {_half_planes(TRIANGLE)}")
def _(spark, sf):
    _configured(spark, sf, LAND)
    return api.features(*LAND, Geometry.polygon(TRIANGLE)).select("id")


@_register("lake_extract_empty", f"SELECT id, class FROM ({ORDER_POINTS}) WHERE lon > 400")
def _(spark, sf):
    """No row group meets the region, so no file is read."""
    _configured(spark, sf, WATER)
    return api.features(*WATER, Geometry.box(400, 400, 401, 401), columns_to_download=["class"]).select("id", "class")


@_register("lake_merged_schema", f"SELECT id, subtype, NULL::VARCHAR AS class FROM ({ORDERS}) UNION ALL SELECT id, NULL, class FROM ({LINES})")
def _(spark, sf):
    lake = Lake(spark, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}")
    folder = lake.folder(*WATER, RELEASE)
    fx.order_features(spark, sf).select("id", "subtype").write.parquet(folder)
    fx.line_features(spark, sf).select("id", "class").write.mode("append").parquet(folder)
    return lake.read(*WATER, RELEASE, merge_schema=True).select("id", "subtype", "class")


@_register("download_sorted_file", f"SELECT id, subtype, 0 AS inversions FROM ({ORDER_POINTS}) WHERE {IN_BOX}")
def _(spark, sf):
    """One file along the curve, although the bbox column is not written; inversions: neighbours in the wrong order."""
    _configured(spark, sf, WATER)
    with tempfile.TemporaryDirectory() as work:
        path = api.convert_bounding_box_to_parquet(*WATER, BOX, columns_to_download=["subtype"], working_directory=work)
        raw = pq.ParquetFile(path).read()
        x, y = np.frombuffer(b"".join(v[5:] for v in raw["geometry"].to_pylist()), "<f8").reshape(-1, 2).T
        cells = [np.clip(((v - lo) / (hi - lo) * (1 << 16)).astype(np.int64), 0, (1 << 16) - 1) for v, lo, hi in ((x, BOX[0], BOX[2]), (y, BOX[1], BOX[3]))]
        wrong = int((np.diff(curve_position(*cells)) < 0).sum())
        table = _local(path)
    return spark.createDataFrame(table).withColumn("inversions", F.lit(wrong))


@_register("download_several_types", f"SELECT 'water' AS type, id FROM ({ORDER_POINTS}) WHERE {IN_BOX} UNION ALL SELECT 'place', id FROM ({PLACE_POINTS}) WHERE {IN_BOX} AND confidence > 0.5")
def _(spark, sf):
    _configured(spark, sf, WATER, PLACE)
    with tempfile.TemporaryDirectory() as work:
        paths = api.convert_bounding_box_to_parquet_for_multiple_types([WATER, PLACE], BOX, pyarrow_filter=[None, [("confidence", ">", 0.5)]], working_directory=work)
        parts = [_local(p).select(["id"]).cast(pa.schema([("id", pa.int64())])).add_column(0, "type", pa.array([u] * pq.read_metadata(p).num_rows, pa.string())) for p, (_, u) in zip(paths, (WATER, PLACE), strict=True)]
    return spark.createDataFrame(pa.concat_tables(parts))


@_register("geoparquet_metadata", f"SELECT TRUE AS covering, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax, 'Point' AS types, '1.1.0' AS version FROM ({ORDER_POINTS}) WHERE {IN_BOX} UNION ALL SELECT FALSE, NULL, NULL, NULL, NULL, 'Point', '1.1.0'")
def _(spark, sf):
    """The geo keys of a file with and of one without a bbox column."""
    _configured(spark, sf, WATER)
    rows = []
    with tempfile.TemporaryDirectory() as work:
        for columns in (None, ["class"]):
            path = api.download_data(*WATER, Geometry.box(*BOX), columns_to_download=columns, working_directory=work)
            key = json.loads(pq.read_schema(path).metadata[b"geo"])
            column = key["columns"][key["primary_column"]]
            rows.append(("covering" in column, *(column.get("bbox") or [None] * 4), ",".join(column["geometry_types"]), key["version"]))
    return spark.createDataFrame(rows, "covering boolean, xmin double, ymin double, xmax double, ymax double, types string, version string")


@_register("result_cache", f"SELECT 'F' AS subtype, count(*) AS n FROM ({ORDER_POINTS}) WHERE {IN_BOX} AND subtype = 'F' UNION ALL SELECT 'O', count(*) FROM ({ORDER_POINTS}) WHERE {IN_BOX} AND subtype = 'O'")
def _(spark, sf):
    """Two filters give two files; a call whose file is there reads that, though the lake is gone."""
    lake = _configured(spark, sf, WATER)
    with tempfile.TemporaryDirectory() as work:
        ask = lambda s, **more: api.download_data(*WATER, Geometry.box(*BOX), RELEASE, [("subtype", "=", s)], working_directory=work, **more)
        paths = {s: ask(s) for s in ("F", "O")}
        api.configure(spark, f"{lake.root}-nowhere")
        rows = [(s, pq.read_metadata(ask(s)).num_rows) for s, p in paths.items() if ask(s) == p]
    return spark.createDataFrame(rows, "subtype string, n long")


@_register("cli_download", f"SELECT id, class FROM ({ORDER_POINTS}) WHERE {IN_BOX} AND subtype = 'O' AND id >= 100")
def _(spark, sf):
    lake = _lake(spark, sf, WATER)
    with tempfile.TemporaryDirectory() as work, contextlib.redirect_stdout(io.StringIO()) as said:
        box = ",".join(map(str, BOX))
        if cli.main([*WATER, "--root", lake.root, f"--geom-filter-bbox={box}", "--filter", "subtype = O", "--filter", "id >= 100", "--work-dir", work], spark):
            raise RuntimeError("the command failed")
        table = _local(said.getvalue().strip()).select(["id", "class"])
    return spark.createDataFrame(table)


@_register("region_files", f"SELECT id, lon, lat FROM ({ORDER_POINTS}) WHERE {_strict(Geometry.polygon(TRIANGLE).bounds)} AND {_half_planes(TRIANGLE)}")
def _(spark, sf):
    """The region from a GeoJSON file, which has to equal that from a WKT file."""
    with tempfile.TemporaryDirectory() as work:
        ring = [*TRIANGLE, TRIANGLE[0]]
        for name, text in (("r.geojson", json.dumps({"type": "Polygon", "coordinates": [ring]})), ("r.wkt", f"POLYGON (({', '.join(f'{x} {y}' for x, y in ring)}))")):
            with open(os.path.join(work, name), "w") as f:
                f.write(text)
        one, other = (regions.from_file(os.path.join(work, n)) for n in ("r.geojson", "r.wkt"))
    if one.digest() != other.digest():
        raise RuntimeError("the files' regions differ")
    return extract(_located(fx.order_features(spark, sf)), one).select("id", F.col("bbox.xmin").alias("lon"), F.col("bbox.ymin").alias("lat"))


@_register("row_group_map", f"SELECT row_group, count(*) AS n, sum(id)::BIGINT AS total FROM ({_grouped(ORDER_POINTS)}) GROUP BY part, row_group")
def _(spark, sf):
    """A function over each row group."""
    lake = _lake(spark, sf, WATER)
    stride, per_file = lake.strides[WATER], PER_FILE

    def told(file: str, group: int, table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        place = group + int(re.search(_NUMBER, file)[1]) % stride * per_file
        return pa.table({"row_group": pa.array([place], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "total": pa.array([int(ids.sum())], pa.int64())})

    return map_parquet_dataset(spark, lake.files(*WATER, RELEASE), told, "row_group int, n long, total long", ["id"])


@_register("row_group_extract", f"SELECT id, class FROM ({_grouped(ORDER_POINTS)}) WHERE part = 0 AND row_group = 0 AND lat > 0 AND lat < 30 AND lon < 180 AND lon > -180 AND subtype = 'F'")
def _(spark, sf):
    lake = _lake(spark, sf, WATER)
    return row_group_scan(spark, lake.files(*WATER, RELEASE)[0], 0, Geometry.box(-180, 0, 180, 30), [("subtype", "=", "F")], ["class"]).select("id", "class")


@_register("streamed_extract", f"SELECT id, class FROM ({ORDER_POINTS}) WHERE {IN_BOX} AND subtype = 'F'")
def _(spark, sf):
    """The lake's files as a stream, extracted exactly once."""
    lake = _lake(spark, sf, WATER)
    folder = lake.folder(*WATER, RELEASE)
    stream = feature_stream(spark, folder, spark.read.parquet(folder).schema)
    extract_stream(stream, f"{lake.root}-out", f"{lake.root}-state", Geometry.box(*BOX), [("subtype", "=", "F")], ["class"]).awaitTermination()
    return spark.read.parquet(f"{lake.root}-out").select("id", "class")


_ORDER_WIDE = _wide_sql(ORDER_POINTS, "base|water", STATUSES, PRIORITIES, where=f"WHERE {IN_BOX}")
_LINE_WIDE = _wide_sql(LINE_POINTS, "base|land_use", FLAGS, LINE_STATUSES, where=f"WHERE {IN_BOX}")
_BOTH_NAMES = sorted({_name("base|water", a, b) for a in STATUSES for b in PRIORITIES} | {_name("base|land_use", a, b) for a in FLAGS for b in LINE_STATUSES})
_BOTH = f"SELECT id, {', '.join(f'coalesce("{n}", FALSE) AS "{n}"' for n in _BOTH_NAMES)} FROM (({_ORDER_WIDE}) UNION ALL BY NAME ({_LINE_WIDE}))"


@_register("lake_wide_form", _BOTH)
def _(spark, sf):
    """Two tables in wide form, with all columns that their names index has, whatever the region."""
    _configured(spark, sf, WATER, LAND)
    packed = api.wide_features([WATER, LAND], Geometry.box(*BOX), RELEASE)
    return packed.unpacked().drop("geometry", "bbox")


@_register("lake_wide_file", _ORDER_WIDE)
def _(spark, sf):
    _configured(spark, sf, WATER)
    with tempfile.TemporaryDirectory() as work:
        table = _local(api.convert_bounding_box_to_wide_form_parquet(*WATER, BOX, working_directory=work))
    return spark.createDataFrame(table)


@_register("lake_wide_observed", f"SELECT id, {', '.join(f'coalesce(prim = {t!r}, FALSE) AS "places|place|{t}"' for t in TYPES)} FROM ({PLACES}) WHERE confidence >= 0.75")
def _(spark, sf):
    """Only columns of categories that occur in places beyond the confidence."""
    _configured(spark, sf, PLACE)
    packed = api.wide_features([PLACE], None, RELEASE, include_all_possible_columns=False, places_use_primary_category_only=True)
    return packed.unpacked().drop("geometry", "bbox")


@_register("lake_column_names", f"SELECT DISTINCT concat_ws('|', 'base', 'water', subtype, class) AS column_name FROM ({ORDERS}) UNION SELECT unnest({sorted(_place_names())!r})")
def _(spark, sf):
    _configured(spark, sf, WATER, PLACE, taxonomy=True)
    return spark.createDataFrame([(n,) for n in api.get_all_possible_column_names(RELEASE)], "column_name string")


@_register("names_index", f"SELECT category, whole FROM (SELECT unnest({[*TYPES, *WORDS]!r}) AS category), (SELECT TRUE AS whole)")
def _(spark, sf):
    """The categories that the names index has of places, and whether its checksums are right."""
    lake = _configured(spark, sf, PLACE, taxonomy=True)
    target = f"{lake.root}-index"
    names.generate_names_index(lake, target, RELEASE, f"{lake.root}-taxonomy")
    whole = names.checked_names_index(spark, target, RELEASE)
    return names.load_names_index(spark, target, PLACE, RELEASE).select("category", F.lit(whole).alias("whole"))


@_register("spatial_sort_order", f"SELECT count(*) AS n, 0::BIGINT AS within_files, 0::BIGINT AS between_files FROM (SELECT event_id FROM events)")
def _(spark, sf):
    """Neighbours in the wrong order along the curve, within the files of a sorted dataset and from one file to the next."""
    folder = write_dataset(fx.points(spark, sf), f"{shared_dir(spark)}/sorted-{uuid.uuid4().hex}")
    rows = spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), hilbert_key(F.col("lon"), F.col("lat"), WORLD).alias("key"))
    from pyspark.sql.window import Window

    before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    files = rows.withColumn("wrong", (before > F.col("key")).cast("long")).groupBy("file").agg(F.count("*").alias("n"), F.sum("wrong").alias("wrong"), F.min("key").alias("low"), F.max("key").alias("high"))
    last = F.lag("high").over(Window.orderBy("file"))  # a row for each file
    return files.withColumn("jump", (last > F.col("low")).cast("long")).agg(F.sum("n").alias("n"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("within_files"), F.coalesce(F.sum("jump"), F.lit(0)).alias("between_files"))


# Lines and polygons. Whole numbers make every product exact, so borders count alike on both sides.

_CORNER = "SELECT event_id AS id, floor(cast((user_id * 7919) % 36000 AS double) / 1e2 - 180e0) AS x, floor(cast((event_id * 104729) % 18000 AS double) / 1e2 - 90e0) AS y, event_id % 41 - 20e0 AS dx, event_id % 23 - 11e0 AS dy FROM events"


def _shapes(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """id, bbox, geometry: a line from a corner, or a rectangle on it, for each event."""
    df = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), F.expr("floor(cast((user_id * 7919) % 36000 as double) / 1e2 - 180e0)").cast("double").alias("x"), F.expr("floor(cast((event_id * 104729) % 18000 as double) / 1e2 - 90e0)").cast("double").alias("y"), F.expr("cast(event_id % 41 - 20 as double)").alias("dx"), F.expr("cast(event_id % 23 - 11 as double)").alias("dy"))
    u, v = F.col("x") + F.col("dx"), F.col("y") + F.col("dy")
    box = F.struct(F.least("x", u).alias("xmin"), F.greatest("x", u).alias("xmax"), F.least("y", v).alias("ymin"), F.greatest("y", v).alias("ymax"))
    return df.withColumn("bbox", box).withColumn("geometry", _wkb(kind, F.col("x"), F.col("y"), u, v)).select("id", "bbox", "geometry")


def _wkb(kind: str, x: Column, y: Column, u: Column, v: Column) -> Column:
    @F.arrow_udf("binary")
    def run(x: pa.Array, y: pa.Array, u: pa.Array, v: pa.Array) -> pa.Array:
        corners = zip(*(c.to_pylist() for c in (x, y, u, v)), strict=True)
        make = (lambda a, b, c, d: Geometry.line([(a, b), (c, d)])) if kind == "line" else (lambda a, b, c, d: Geometry.box(min(a, c), min(b, d), max(a, c), max(b, d)))
        return pa.array([make(*c).to_wkb() for c in corners], pa.binary())

    return run(x, y, u, v)


def _apart(vertices: list[tuple[str, str]], axes: list[tuple[str, str]]) -> str:
    """Whether a convex shape and the triangle have no common point: an axis on which their projections leave a gap."""
    tests = []
    for ax, ay in axes:
        mine = [f"({ax}) * ({px}) + ({ay}) * ({py})" for px, py in vertices]
        theirs = [f"({ax}) * ({px!r}) + ({ay}) * ({py!r})" for px, py in TRIANGLE]
        tests.append(f"greatest({', '.join(mine)}) < least({', '.join(theirs)}) OR greatest({', '.join(theirs)}) < least({', '.join(mine)})")
    return " OR ".join(tests)


_NORMALS = [(repr(y0 - y1), repr(x1 - x0)) for (x0, y0), (x1, y1) in zip(TRIANGLE, [*TRIANGLE[1:], TRIANGLE[0]], strict=True)]
_NEAR = "least(x, x + dx) < 60 AND greatest(x, x + dx) > -60 AND least(y, y + dy) < 30 AND greatest(y, y + dy) > -30"


@_register("line_intersects", f"SELECT id FROM ({_CORNER}) WHERE {_NEAR} AND NOT ({_apart([('x', 'y'), ('x + dx', 'y + dy')], [*_NORMALS, ('1', '0'), ('0', '1'), ('-dy', 'dx')])})")
def _(spark, sf):
    return extract(_shapes(spark, sf, "line"), Geometry.polygon(TRIANGLE)).select("id")


@_register("polygon_intersects_polygons", f"SELECT id FROM ({_CORNER}) WHERE {_NEAR} AND NOT ({_apart([('x', 'y'), ('x + dx', 'y'), ('x', 'y + dy'), ('x + dx', 'y + dy')], [*_NORMALS, ('1', '0'), ('0', '1')])})")
def _(spark, sf):
    return extract(_shapes(spark, sf, "box"), Geometry.polygon(TRIANGLE)).select("id")


@_register("theme_type_pairs", " UNION ALL ".join(f"SELECT '{t}' AS theme, '{u}' AS type, '{','.join(W.HIERARCHIES[t, u])}' AS levels, count(*) AS n FROM ({sql})" for (t, u), sql in TABLES.items()))
def _(spark, sf):
    """The tables that a lake has folders of, with their hierarchies and rows."""
    lake = _lake(spark, sf, *TABLES)
    known = W.hierarchies(RELEASE)
    parts = [lake.read(t, u, RELEASE).agg(F.count("*").alias("n")).select(F.lit(t).alias("theme"), F.lit(u).alias("type"), F.lit(",".join(known[t, u])).alias("levels"), "n") for t, u in lake.pairs(RELEASE)]
    return reduce(DataFrame.unionByName, parts)
