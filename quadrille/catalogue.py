"""The registered queries of the spatial engine and their SQL.

Every query runs over whole tables; names, units and regions are stated here
once and used by both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.cells import GEOHASH, geohash_bounds, geohash_region
from quadrille.functions.geometry import Geometry
from quadrille.functions.hexagons import cell_region, h3_region
from quadrille.functions.hilbert import hilbert_key
from quadrille.operators import wide as W
from quadrille.operators.extract import extract, in_box, projected, touches_box
from quadrille.operators.order import WORLD, spatially_sorted
from quadrille.operators.spatial_join import spatial_join
from quadrille.plans.predicate import compiled, parsed_all
from quadrille.sources import fixtures as fx
from quadrille.sources.index import load_release_index, row_group_rows
from quadrille.sources.lake import Lake
from quadrille.sources.shared import shared_dir
from quadrille.sources.sink import write_dataset
from quadrille.sources.taxonomy import split_paths

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

POINTS = """SELECT event_id AS id, cast((user_id * 7919) % 36000 AS double) / 1e2 - 180e0 AS lon,
    cast((event_id * 104729) % 18000 AS double) / 1e2 - 90e0 AS lat, event_type, value FROM events"""
BOXES = f"SELECT id, lon AS xmin, lon + cast(id % 7 AS double) / 1e1 AS xmax, lat AS ymin, lat + cast(id % 5 AS double) / 1e1 AS ymax FROM ({POINTS})"
ORDERS = "SELECT o_orderkey AS id, o_orderstatus AS subtype, nullif(o_orderpriority, '4-NOT SPECIFIED') AS class FROM orders"
LINES = "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS subtype, l_linestatus AS class FROM lineitem"
PLACES = "SELECT p_partkey AS id, p_type AS prim, CASE WHEN p_size % 4 = 0 THEN NULL ELSE string_split(p_name, ' ') END AS alt, cast(p_size AS double) / 5e1 AS confidence FROM part"

BOX = (-60.0, -30.0, 60.0, 30.0)
TRIANGLE = ((-60.0, -30.0), (60.0, -30.0), (0.0, 30.0))
HOLE = ((-20.0, -20.0), (20.0, -20.0), (0.0, 10.0))
GEOHASHES = "s,ezs,6g"
#: Rows in a row group of the points.
POINT_GROUP = 10_000

# The values that the driver's tables take.
STATUSES, PRIORITIES = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", None)
FLAGS, LINE_STATUSES = ("A", "N", "R"), ("F", "O")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
WORDS = ("anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red", "ring", "rod", "small", "widget")
#: category, path: types and part of the words; the other words are unseen by the taxonomy.
TAXONOMY = [(t, f"[product,type,{t}]") for t in TYPES] + [("blue", "[look,colour]"), ("red", "[look,colour]"), ("large", "[look,size]"), ("small", "[look,size]"), ("anvil", "[tool]"), ("bolt", "[part,metal,bolt]")]


def _register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        _QUERIES[name] = query
        if sql:
            _SQL[name] = sql
        return query

    return keep


def queries() -> dict[str, Query]:
    from quadrille import catalogue_lake  # noqa: F401 - registers its queries

    return dict(_QUERIES)


def written_lake_queries() -> set[str]:
    """The queries of catalogue_lake."""
    return {name for name, query in queries().items() if query.__module__.endswith("catalogue_lake")}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _strict(bounds, x0="lon", x1="lon", y0="lat", y1="lat") -> str:
    xmin, ymin, xmax, ymax = (f"({v!r})::DOUBLE" for v in bounds)
    return f"{x0} < {xmax} AND {x1} > {xmin} AND {y0} < {ymax} AND {y1} > {ymin}"


# Filters and projections.


@_register("bbox_extract", f"SELECT id, lon, lat FROM ({POINTS}) WHERE {_strict(BOX)}")
def _(spark, sf):
    return extract(fx.points(spark, sf), Geometry.box(*BOX)).select("id", "lon", "lat")


@_register("bbox_edge_strict", f"SELECT id, lon, lat FROM ({POINTS}) WHERE {_strict((-180.0, -90.0, 179.5, 90.0))}")
def _(spark, sf):
    return extract(fx.points(spark, sf), Geometry.box(-180, -90, 179.5, 90)).select("id", "lon", "lat")


@_register("bbox_closed_index", f"SELECT id FROM ({BOXES}) WHERE xmin <= 60 AND xmax >= -60 AND ymin <= 30 AND ymax >= -30")
def _(spark, sf):
    return fx.boxes(spark, sf).where(touches_box(BOX)).select("id")


@_register("bbox_of_boxes", f"SELECT id FROM ({BOXES}) WHERE {_strict(BOX, 'xmin', 'xmax', 'ymin', 'ymax')}")
def _(spark, sf):
    return fx.boxes(spark, sf).where(in_box(BOX)).select("id")


@_register("bbox_and_predicate", f"SELECT id, lon, lat, value FROM ({POINTS}) WHERE {_strict(BOX)} AND event_type = 'view'")
def _(spark, sf):
    return extract(fx.points(spark, sf), Geometry.box(*BOX), [("event_type", "=", "view")]).select("id", "lon", "lat", "value")


@_register("dnf_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity >= 40) OR (l_linestatus = 'O' AND l_discount < 0.02)")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    test = [[("l_returnflag", "=", "R"), ("l_quantity", ">=", 40)], [("l_linestatus", "=", "O"), ("l_discount", "<", 0.02)]]
    return df.where(compiled(test, df.schema)).select("l_orderkey", "l_linenumber", "l_quantity")


@_register("not_in_keeps_null", f"SELECT id, kind FROM (SELECT id, nullif(event_type, 'error') AS kind FROM ({POINTS})) WHERE kind NOT IN ('view') OR kind IS NULL")
def _(spark, sf):
    return fx.points(spark, sf).select("id", F.expr("nullif(event_type, 'error')").alias("kind")).where(compiled([("kind", "not in", ["view"])]))


@_register("in_matches_null", f"SELECT id, kind FROM (SELECT id, nullif(event_type, 'error') AS kind FROM ({POINTS})) WHERE kind IN ('view') OR kind IS NULL")
def _(spark, sf):
    return fx.points(spark, sf).select("id", F.expr("nullif(event_type, 'error')").alias("kind")).where(compiled([("kind", "in", ["view", None])]))


@_register("nested_field_filter", f"SELECT id FROM ({PLACES}) WHERE prim = 'PROMO' AND confidence > 0.9")
def _(spark, sf):
    df = fx.place_features(spark, sf)
    return df.where(compiled([[(("categories", "primary"), "=", "PROMO"), ("confidence", ">", 0.9)]], df.schema)).select("id")


@_register("cli_filter", f"SELECT id, value FROM ({POINTS}) WHERE value >= 100 AND event_type = 'click'")
def _(spark, sf):
    df = fx.points(spark, sf)
    return df.where(compiled(parsed_all(["value >= 100", "event_type = click"]), df.schema)).select("id", "value")


@_register("projection_schema_order", f"SELECT id, event_type, value, NULL::VARCHAR AS geometry FROM ({POINTS})")
def _(spark, sf):
    return projected(fx.points(spark, sf), ["value", "event_type"]).withColumn("geometry", F.col("geometry").cast("string"))


@_register("empty_region", f"SELECT id, value FROM ({POINTS}) WHERE lon > 400")
def _(spark, sf):
    return extract(fx.points(spark, sf), Geometry.box(400, 400, 401, 401)).select("id", "value")


# Geometry.


def _half_planes(corners) -> str:
    """Inside a counter-clockwise convex polygon, border included."""
    pairs = zip(corners, [*corners[1:], corners[0]], strict=True)
    return " AND ".join(f"({x1 - x0!r}) * (lat - ({y0!r})) - ({y1 - y0!r}) * (lon - ({x0!r})) >= 0" for (x0, y0), (x1, y1) in pairs)


def _open_half_planes(corners) -> str:
    return _half_planes(corners).replace(">=", ">")


@_register("polygon_intersects", f"SELECT id, lon, lat FROM ({POINTS}) WHERE {_strict(Geometry.polygon(TRIANGLE).bounds)} AND {_half_planes(TRIANGLE)}")
def _(spark, sf):
    return extract(fx.points(spark, sf, wkb=True), Geometry.polygon(TRIANGLE)).select("id", "lon", "lat")


@_register("polygon_with_hole", f"SELECT id, lon, lat FROM ({POINTS}) WHERE {_strict(Geometry.polygon(TRIANGLE).bounds)} AND {_half_planes(TRIANGLE)} AND NOT ({_open_half_planes(HOLE)})")
def _(spark, sf):
    return extract(fx.points(spark, sf, wkb=True), Geometry.polygon(TRIANGLE, HOLE)).select("id", "lon", "lat")


def _closed(bounds) -> str:
    xmin, ymin, xmax, ymax = bounds
    return f"lon BETWEEN {xmin!r} AND {xmax!r} AND lat BETWEEN {ymin!r} AND {ymax!r}"


@_register("geohash_region", f"SELECT id, lon, lat FROM ({POINTS}) WHERE {_strict(geohash_region(GEOHASHES).bounds)} AND ({' OR '.join('(' + _closed(geohash_bounds(g)) + ')' for g in GEOHASHES.split(','))})")
def _(spark, sf):
    return extract(fx.points(spark, sf, wkb=True), geohash_region(GEOHASHES)).select("id", "lon", "lat")


@_register("geohash_union_is_a_box", f"SELECT id, lon, lat FROM ({POINTS}) WHERE {_strict(geohash_bounds('s'), 'lon', 'lon', 'lat', 'lat')}")
def _(spark, sf):
    """The 32 parts of a cell are the cell: the strict box test alone decides."""
    parts = ",".join(f"s{c}" for c in GEOHASH)
    return extract(fx.points(spark, sf, wkb=True), geohash_region(parts)).select("id", "lon", "lat")


#: Cells apart from one another: a pentagon, one of the coarsest level and one of the next.
H3_CELLS = "8075fffffffffff,8029fffffffffff,8166bffffffffff"
_IN_CELLS = " OR ".join(f"({_half_planes(cell_region(c).polygons[0][0][:-1].tolist())})" for c in H3_CELLS.split(","))


@_register("h3_region", f"SELECT id, lon, lat FROM ({POINTS}) WHERE {_strict(h3_region(H3_CELLS).bounds)} AND ({_IN_CELLS})")
def _(spark, sf):
    return extract(fx.points(spark, sf, wkb=True), h3_region(H3_CELLS)).select("id", "lon", "lat")


def _zigzag(teeth: int) -> list[tuple[float, float]]:
    """A saw of this many teeth above a straight base, by whole numbers."""
    top = [(60.0 - 120.0 * k / (2 * teeth), 40.0 if k % 2 else 10.0 + k % 5) for k in range(2 * teeth + 1)]
    return [(-60.0, -30.0), (60.0, -30.0), *top]


SAW = _zigzag(60)
_SAW_EDGES = ", ".join(f"({a!r}, {b!r}, {c!r}, {d!r})" for (a, b), (c, d) in zip(SAW, [*SAW[1:], SAW[0]], strict=True))
_SAW_CROSS = "(x1 - x0) * (lat - y0) - (y1 - y0) * (lon - x0)"


@_register(
    "polygon_by_cells",
    f"WITH edges(x0, y0, x1, y1) AS (VALUES {_SAW_EDGES}), near AS (SELECT id, lon, lat FROM ({POINTS}) WHERE {_strict(Geometry.polygon(SAW).bounds)}) "
    f"SELECT id, lon, lat FROM near JOIN edges ON TRUE GROUP BY id, lon, lat HAVING count(*) FILTER (WHERE (y0 > lat) <> (y1 > lat) AND ({_SAW_CROSS} > 0) = (y1 > y0)) % 2 = 1 "
    f"OR count(*) FILTER (WHERE {_SAW_CROSS} = 0 AND lon BETWEEN least(x0, x1) AND greatest(x0, x1) AND lat BETWEEN least(y0, y1) AND greatest(y0, y1)) > 0",
)
def _(spark, sf):
    """Cells of the region decide most points natively, its border's edges the others."""
    return extract(fx.points(spark, sf, wkb=True), Geometry.polygon(SAW)).select("id", "lon", "lat")


RECTANGLES = """SELECT id, x AS xmin, x + w AS xmax, y AS ymin, y + h AS ymax FROM (
    SELECT s_suppkey::BIGINT AS id, cast((s_suppkey * 7919) % 360 - 180 AS double) AS x, cast((s_suppkey * 104729) % 180 - 90 AS double) AS y, cast(s_suppkey % 7 AS double) AS w, cast(s_suppkey % 5 AS double) AS h FROM supplier
    UNION ALL SELECT (-1 - n_nationkey)::BIGINT, cast(n_nationkey * 13 - 180 AS double), cast(n_nationkey * 5 - 90 AS double), 40e0, 25e0 FROM nation)"""


@_register("spatial_join_boxes", f"SELECT p.id, r.id AS rectangle FROM ({POINTS}) p JOIN ({RECTANGLES}) r ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax")
def _(spark, sf):
    """Points by the rectangles that hold them."""
    return spatial_join(fx.points(spark, sf).select("id", "bbox"), fx.rectangles(spark, sf)).select("left.id", F.col("right.id").alias("rectangle"))


@_register("spatial_join_of_one_table", f"SELECT a.id, b.id AS other FROM ({RECTANGLES}) a JOIN ({RECTANGLES}) b ON a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax")
def _(spark, sf):
    rows = fx.rectangles(spark, sf)
    return spatial_join(rows, rows).select("left.id", F.col("right.id").alias("other"))


@_register(
    "spatial_join_polygons",
    f"SELECT p.id, r.id AS triangle FROM ({POINTS}) p JOIN ({RECTANGLES}) r ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax WHERE xmax > xmin AND ymax > ymin AND (lon - xmin) * (ymax - ymin) + (lat - ymin) * (xmax - xmin) <= (xmax - xmin) * (ymax - ymin)",
)
def _(spark, sf):
    """Points by the triangles that hold them."""
    return spatial_join(fx.points(spark, sf, wkb=True).select("id", "bbox", "geometry"), fx.triangles(spark, sf), exact=True).select("left.id", F.col("right.id").alias("triangle"))


@_register("arrow_expression", f"SELECT id, kind FROM (SELECT *, nullif(event_type, 'error') AS kind FROM ({POINTS})) WHERE (kind IS NULL OR kind <> 'view') AND value * 2 > 100 OR lon = 12.5")
def _(spark, sf):
    """A predicate as callers of Arrow write it: `not in` keeps null."""
    df = fx.points(spark, sf).withColumn("kind", F.expr("nullif(event_type, 'error')"))
    test = ~pc.field("kind").isin(["view"]) & (pc.field("value") * 2 > 100) | (pc.field("bbox", "xmin") == 12.5)
    return extract(df, where=test).select("id", "kind")


@_register("hilbert_key_counts", f"SELECT least(greatest(floor((lon + 180) / 360 * 4), 0), 3)::BIGINT AS cx, least(greatest(floor((lat + 90) / 180 * 4), 0), 3)::BIGINT AS cy, count(*) AS n, 1::BIGINT AS keys FROM ({POINTS}) GROUP BY ALL")
def _(spark, sf):
    """Each cell of a 4 by 4 grid is one run of the curve: its points have one key prefix."""
    p = fx.points(spark, sf)
    cell = lambda v, lo, size: F.least(F.greatest(F.floor((F.col(v) - lo) / size * 4), F.lit(0)), F.lit(3))
    keyed = p.select(cell("lon", -180, 360).alias("cx"), cell("lat", -90, 180).alias("cy"), F.shiftright(hilbert_key(F.col("lon"), F.col("lat"), WORLD), 28).alias("prefix"))
    return keyed.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.countDistinct("prefix").alias("keys"))


@_register("spatial_sort", f"SELECT id, lon, lat FROM ({POINTS}) WHERE {_strict(BOX)}")
def _(spark, sf):
    return spatially_sorted(extract(fx.points(spark, sf), Geometry.box(*BOX)), BOX).select("id", "lon", "lat")


# Hierarchies and wide forms.


def _paths(spark, first, second) -> DataFrame:
    return spark.createDataFrame([(a, b) for a in first for b in second], "subtype string, class string")


def _name(*levels) -> str:
    out = []
    for x in levels:
        if x is None:
            break
        out.append(x)
    return "|".join(out)


def _equal(column: str, value: str | None) -> str:
    return f"{column} IS NULL" if value is None else f"{column} = '{value}'"


def _wide_sql(table: str, prefix: str, first, second, depth: int = 2, where: str = "") -> str:
    names = {}
    for a in first:
        for b in second if depth == 2 else (None,):
            test = _equal("subtype", a) + (f" AND {_equal('class', b)}" if depth == 2 else "")
            names.setdefault(_name(prefix, a, *([b] if depth == 2 else [])), []).append(f"({test})")
    return f"SELECT id, {', '.join(f'coalesce({" OR ".join(t)}, FALSE) AS "{n}"' for n, t in sorted(names.items()))} FROM ({table}) {where}"


ORDER_PAIR, LINE_PAIR = ("base", "water"), ("base", "land_use")


@_register("hierarchy_distinct", f"SELECT DISTINCT subtype, class, concat_ws('|', 'base', 'water', subtype, class) AS column_name FROM ({ORDERS})")
def _(spark, sf):
    return W.definitions(fx.order_features(spark, sf), ORDER_PAIR, ("subtype", "class")).select("subtype", "class", "column_name")


@_register("category_union_unnest", f"SELECT category FROM (SELECT prim AS category FROM ({PLACES}) UNION SELECT unnest(alt) FROM ({PLACES})) WHERE category IS NOT NULL")
def _(spark, sf):
    return W.observed_categories(fx.place_features(spark, sf))


@_register("wide_two_level", _wide_sql(ORDERS, "base|water", STATUSES, PRIORITIES))
def _(spark, sf):
    return W.standard(fx.order_features(spark, sf), ORDER_PAIR, None, _paths(spark, STATUSES, PRIORITIES), ("id",)).unpacked()


@_register("wide_depth_1", _wide_sql(ORDERS, "base|water", STATUSES, PRIORITIES, 1))
def _(spark, sf):
    return W.standard(fx.order_features(spark, sf), ORDER_PAIR, 1, _paths(spark, STATUSES, PRIORITIES), ("id",)).unpacked()


@_register("wide_depth_0", f'SELECT id, TRUE AS "base|water" FROM ({ORDERS})')
def _(spark, sf):
    return W.standard(fx.order_features(spark, sf), ORDER_PAIR, 0, None, ("id",)).unpacked()


@_register("wide_pruned", _wide_sql(ORDERS, "base|water", ("F",), ("1-URGENT", None), where="WHERE subtype = 'F' AND (class = '1-URGENT' OR class IS NULL)"))
def _(spark, sf):
    rows = fx.order_features(spark, sf).where(compiled([("subtype", "=", "F"), ("class", "in", ["1-URGENT", None])]))
    return W.standard(rows, ORDER_PAIR, None, None, ("id",)).unpacked()


def _taxonomy(spark) -> DataFrame:
    return split_paths(spark.createDataFrame(TAXONOMY, "category string, hierarchy string"), 3)


def _whole_taxonomy(spark) -> DataFrame:
    return W.backfilled(_taxonomy(spark), spark.createDataFrame([(c,) for c in (*TYPES, *WORDS)], "category string"))


def _place_names(depth: int = 3) -> dict[str, list[str]]:
    paths = {c: p[1:-1].split(",") for c, p in TAXONOMY} | {w: [w] for w in WORDS if w not in dict(TAXONOMY)}
    names: dict[str, list[str]] = {}
    for c, path in paths.items():
        names.setdefault("|".join(["places", "place", *path[:depth]]), []).append(c)
    return names


def _places_sql(depth: int = 3, primary_only: bool = False, confidence: float = 0.75) -> str:
    def test(categories: list[str]) -> str:
        own = f"prim IN ({', '.join(repr(c) for c in categories)})"
        return own if primary_only else f"{own} OR list_has_any(alt, {categories!r})"

    return f"SELECT id, {', '.join(f'coalesce({test(c)}, FALSE) AS "{n}"' for n, c in sorted(_place_names(depth).items()))} FROM ({PLACES}) WHERE confidence >= {confidence}"


@_register("wide_multi_hot", _places_sql())
def _(spark, sf):
    return W.places(fx.place_features(spark, sf), _whole_taxonomy(spark), keep=("id",)).unpacked()


@_register("wide_multi_hot_depth_1", _places_sql(depth=1))
def _(spark, sf):
    return W.places(fx.place_features(spark, sf), _whole_taxonomy(spark), 1, keep=("id",)).unpacked()


@_register("wide_primary_only", _places_sql(primary_only=True))
def _(spark, sf):
    return W.places(fx.place_features(spark, sf), _whole_taxonomy(spark), primary_only=True, keep=("id",)).unpacked()


@_register("wide_min_confidence", _places_sql(confidence=0.3))
def _(spark, sf):
    return W.places(fx.place_features(spark, sf), _whole_taxonomy(spark), min_confidence=0.3, keep=("id",)).unpacked()


def _two_types(spark, sf) -> W.Packed:
    one = W.standard(fx.order_features(spark, sf), ORDER_PAIR, None, _paths(spark, STATUSES, PRIORITIES), ("id",))
    other = W.standard(fx.line_features(spark, sf), LINE_PAIR, None, _paths(spark, FLAGS, LINE_STATUSES), ("id",))
    return W.united([one, other])


_UNION_NAMES = sorted({_name("base|water", a, b) for a in STATUSES for b in PRIORITIES} | {_name("base|land_use", a, b) for a in FLAGS for b in LINE_STATUSES})
_UNION = f"({_wide_sql(ORDERS, 'base|water', STATUSES, PRIORITIES)}) UNION ALL BY NAME ({_wide_sql(LINES, 'base|land_use', FLAGS, LINE_STATUSES)})"
_UNION_FALSE = f"SELECT id, {', '.join(f'coalesce("{n}", FALSE) AS "{n}"' for n in _UNION_NAMES)} FROM ({_UNION})"


@_register("wide_multi_type_union", _UNION_FALSE)
def _(spark, sf):
    return _two_types(spark, sf).unpacked()


@_register("wide_union_by_name", _UNION_FALSE)
def _(spark, sf):
    one = W.standard(fx.order_features(spark, sf), ORDER_PAIR, None, _paths(spark, STATUSES, PRIORITIES), ("id",)).unpacked()
    other = W.standard(fx.line_features(spark, sf), LINE_PAIR, None, _paths(spark, FLAGS, LINE_STATUSES), ("id",)).unpacked()
    return W.union_by_name([one, other], ("id",))


@_register("wide_pack", f"SELECT id, array_to_string([i FOR i IN [{', '.join(f'CASE WHEN "{n}" THEN {i} END' for i, n in enumerate(sorted(_place_names())))}] IF i IS NOT NULL], ',') AS packed FROM ({_places_sql()})")
def _(spark, sf):
    wide = W.places(fx.place_features(spark, sf), _whole_taxonomy(spark), keep=("id",)).unpacked()
    return W.packed(wide, sorted(_place_names())).select("id", F.array_join(F.col(W.INDEXES).cast("array<string>"), ",").alias("packed"))


@_register("wide_unpack", _places_sql())
def _(spark, sf):
    wide = W.places(fx.place_features(spark, sf), _whole_taxonomy(spark), keep=("id",)).unpacked()
    names = sorted(_place_names())
    return W.unpacked(W.packed(wide, names), names)


@_register("wide_category_counts", f"UNPIVOT (SELECT {', '.join(f'count(*) FILTER ("{n}") AS "{n}"' for n in _UNION_NAMES)} FROM ({_UNION_FALSE})) ON COLUMNS(*) INTO NAME column_name VALUE n")
def _(spark, sf):
    return _two_types(spark, sf).counts()


@_register("column_names_listing", f"SELECT DISTINCT concat_ws('|', 'base', 'water', subtype, class) AS column_name FROM ({ORDERS}) UNION SELECT DISTINCT concat_ws('|', 'base', 'land_use', subtype, class) FROM ({LINES})")
def _(spark, sf):
    one = W.definitions(fx.order_features(spark, sf), ORDER_PAIR, ("subtype", "class"))
    other = W.definitions(fx.line_features(spark, sf), LINE_PAIR, ("subtype", "class"))
    return one.select("column_name").union(other.select("column_name")).distinct().orderBy("column_name")


_TAXONOMY_SQL = "VALUES " + ", ".join(f"('{c}', '{p[1:-1]}')" for c, p in TAXONOMY)


@_register(
    "taxonomy_backfill",
    f"""WITH t AS (SELECT col0 AS category, string_split(col1, ',') AS p FROM ({_TAXONOMY_SQL})), seen AS (SELECT prim AS category FROM ({PLACES}) UNION SELECT unnest(alt) FROM ({PLACES}))
    SELECT category, p[1] AS "1", p[2] AS "2", p[3] AS "3" FROM t UNION ALL SELECT category, category, NULL, NULL FROM seen ANTI JOIN t USING (category) WHERE category IS NOT NULL""",
)
def _(spark, sf):
    return W.backfilled(_taxonomy(spark), W.observed_categories(fx.place_features(spark, sf)))


@_register("row_group_index", f"SELECT count(*) AS n, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM ({POINTS})")
def _(spark, sf):
    base, release = f"{shared_dir(spark)}/row-groups-{uuid.uuid4().hex}", "2024-09-18.0"
    lake = Lake(spark, f"{base}/lake")
    write_dataset(fx.points(spark, sf), lake.folder("base", "point", release), row_group_size=POINT_GROUP)
    boxes = load_release_index(lake, f"{base}/index", "base", "point", release)
    rows = row_group_rows(spark, lake.files("base", "point", release))
    b = F.col("bbox")
    return boxes.join(rows, ["filename", "row_group"]).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.min(b.xmin).alias("xmin"), F.min(b.ymin).alias("ymin"), F.max(b.xmax).alias("xmax"), F.max(b.ymax).alias("ymax"))
