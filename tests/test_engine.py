import json
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadrille import api, catalogue, cli
from quadrille.errors import BadParameter, HierarchyDepthOutOfBoundsWarning, MissingColumnError, NegativeHierarchyDepthError, ReleaseVersionNotSupportedError
from quadrille.functions.geometry import Geometry
from quadrille.operators import wide as W
from quadrille.operators.extract import extract, projected
from quadrille.plans.predicate import compiled, parsed
from quadrille.sources import index, names, regions, sink
from quadrille.sources.lake import Lake, checked_release
from quadrille.sources.rowgroups import map_parquet_dataset, row_group_scan
from quadrille.sources.taxonomy import read_taxonomy
from quadrille.streaming.stateless import extract_stream, feature_stream

SF = "/root/testdata/sf0.001"
RELEASE = "2024-09-18.0"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("events", "supplier", "nation", "lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_catalogue_matches_sql(spark, oracle, name):
    ours = catalogue.queries()[name](spark, SF)
    theirs = oracle.execute(catalogue.oracle_sql()[name])
    columns = sorted(ours.columns)
    other = [d[0] for d in theirs.description]
    assert columns == sorted(other)
    left = sorted(str([row[c] for c in columns]) for row in ours.collect())
    right = sorted(str([row[other.index(c)] for c in columns]) for row in theirs.fetchall())
    assert left == right


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """A lake of three tables in two files each, with small row groups."""
    root = tmp_path_factory.mktemp("lake")

    def write(df, theme, type_):
        boxed = df.withColumn("geometry", F.udf(lambda x, y: Geometry.point(x, y).to_wkb(), "binary")("x", "y"))
        boxed = boxed.withColumn("bbox", F.struct(F.col("x").alias("xmin"), F.col("x").alias("xmax"), F.col("y").alias("ymin"), F.col("y").alias("ymax"))).drop("x", "y")
        boxed.repartitionByRange(2, "bbox.xmin").sortWithinPartitions("bbox.xmin").write.option("parquet.block.row.count.limit", 20).parquet(f"file://{root}/{RELEASE}/theme={theme}/type={type_}")

    grid = spark.range(100).select(F.format_string("f%02d", "id").alias("id"), (F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"), F.col("id").alias("n"))
    kinds = F.array(F.lit("river"), F.lit("lake"), F.lit(None))
    write(grid.select("id", "x", "y", F.get(kinds, (F.col("n") % 3).cast("int")).alias("subtype"), F.when(F.col("n") % 2 == 0, "big").alias("class"), "n"), "base", "water")
    write(grid.select("id", "x", "y", F.lit("house").alias("subtype"), F.lit("home").alias("class")), "buildings", "building")
    cats = F.struct(F.when(F.col("n") % 2 == 0, "cafe").otherwise("museum").alias("primary"), F.when(F.col("n") % 5 == 0, F.array(F.lit("bar"), F.lit("cafe"), F.lit(None))).alias("alternate"))
    write(grid.select("id", "x", "y", F.when(F.col("n") != 7, cats).alias("categories"), F.when(F.col("n") == 8, F.lit(math.nan)).otherwise(F.col("n") / 100).alias("confidence")), "places", "place")
    (root / "taxonomy.csv").write_text("category;hierarchy\ncafe;[eat,cafe]\nbar;[eat,bar]\n")
    target = tmp_path_factory.mktemp("index")
    api.configure(spark, f"file://{root}", f"file://{target}", f"file://{root}/taxonomy.csv")
    return Lake(spark, f"file://{root}")


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", math.nan), (3, None, None)], "i int, s string, x double")
    found = lambda p: [r.i for r in df.where(compiled(p, df.schema)).collect()]
    assert found([("s", "not in", ["a"])]) == [2, 3] and found([("s", "in", ["a", None])]) == [1, 3] and found([("s", "in", [None])]) == [3]
    assert found([("x", ">=", 0.5)]) == [1] and found([("x", "<", 5)]) == [1]
    assert found("i > 1") == [2, 3] and found(F.col("i") == 1) == [1]
    assert found([[("i", "=", 1)], [("i", "==", 3)]]) == [1, 3] and found([("i", "!=", 1), ("i", "<=", 2)]) == [2]
    for bad in ([], [[]]):
        with pytest.raises(ValueError, match="Malformed"):
            compiled(bad)
    with pytest.raises(ValueError):
        compiled([("i", "~", 1)])
    assert parsed("a.b = x") == ("a.b", "=", "x") and parsed("a >= 1.5") == ("a", ">=", 1.5) and parsed("a = -1") == ("a", "=", "-1")
    with pytest.warns(DeprecationWarning):
        assert parsed("a,b = 2")[0] == "a.b"
    for bad in ("a = ", "a in x", "a = b c"):
        with pytest.raises(BadParameter):
            parsed(bad)


def test_extract_and_projection(lake):
    df = lake.read("base", "water")
    box = Geometry.box(2, 2, 5, 5)
    assert extract(df, box).count() == 4  # the border does not count
    triangle = Geometry.polygon([(1, 1), (6, 1), (6, 6)])
    inside = {r.id for r in extract(df, triangle).collect()}
    assert inside == {f"f{y}{x}" for x in range(2, 6) for y in range(2, x + 1)}
    assert extract(df, triangle, exact=False).count() == 16
    assert projected(df, ["class"]).columns == ["id", "class", "geometry"] and projected(df, []).columns == df.columns == projected(df, None).columns
    with pytest.raises(MissingColumnError, match="a, b"):
        projected(df, ["b", "a"])
    empty = extract(df, Geometry.box(-10, -10, -9.9, -9.9), columns=["n"])
    assert empty.count() == 0 and empty.columns == ["id", "n", "geometry"]
    plan = extract(df, box, [("n", ">", 3)], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(bbox.xmin" in plan and "GreaterThan(n" in plan and "Python" not in plan


def test_releases_and_pairs(lake):
    assert lake.releases() == [RELEASE] and lake.newest() == RELEASE
    assert lake.pairs() == [("base", "water"), ("buildings", "building"), ("places", "place")]
    with pytest.raises(ReleaseVersionNotSupportedError):
        checked_release("2024-01-01.0")


def test_row_group_query_reads_the_index(spark, monkeypatch):
    from quadrille import catalogue

    sf = "/root/testdata/sf0.001"
    query = catalogue.queries()["row_group_index"]
    want = spark.read.parquet(f"{sf}/events.parquet").count()
    assert query(spark, sf).first().n == want
    monkeypatch.setattr(catalogue, "load_release_index", lambda *a: index.load_release_index(*a).limit(0), raising=False)
    assert query(spark, sf).first().n == 0


def test_row_group_index(spark, lake, tmp_path):
    target = f"file://{tmp_path}"
    assert index.generate_release_index(lake, target) and not index.generate_release_index(lake, target)
    assert index.download_existing_release_index(spark, target, RELEASE) and not index.download_existing_release_index(spark, target, "2025-01-01.0")
    whole = index.load_release_index(lake, target, "base", "water").collect()
    counts = {r.filename: r.row_groups for r in index.row_group_counts(spark, lake.files("base", "water")).collect()}
    assert sum(counts.values()) == len(whole) > 2
    for r in whole:
        t = pq.ParquetFile(r.filename.removeprefix("file://")).read_row_group(r.row_group)["bbox"].combine_chunks()
        assert (r.bbox.xmin, r.bbox.xmax) == (min(t.field("xmin").to_pylist()), max(t.field("xmax").to_pylist()))
    few = index.load_release_index(lake, target, "base", "water", region=Geometry.box(0, 0, 1, 1))
    assert 0 < few.count() < len(whole) and len(index.pruned_files(few)) == 1
    both = index.load_release_indexes(lake, target, lake.pairs())
    assert both.select("theme", "type").distinct().count() == 3
    with pytest.raises(NotImplementedError):
        index.load_release_index(lake, target, "base", "water", remote_index=True)


def test_row_groups_as_units(spark, lake):
    files = lake.files("base", "water")
    sizes = map_parquet_dataset(spark, files, lambda f, g, t: pa.table({"f": [f], "g": pa.array([g], pa.int32()), "n": [t.num_rows]}), "f string, g int, n long")
    rows = sizes.collect()
    assert sum(r.n for r in rows) == 100 and {r.f for r in rows} == set(files) and len({(r.f, r.g) for r in rows}) == len(rows)
    one = row_group_scan(spark, files[0], 0, Geometry.box(-1, -1, 1.5, 3), [("n", ">", 0)], ["n"])
    assert one.columns == ["id", "n", "geometry"] and 0 < one.count() < 20


def test_names_index(spark, lake, tmp_path):
    target, taxonomy = f"file://{tmp_path}", f"{lake.root}/taxonomy.csv"
    assert names.generate_names_index(lake, target, None, taxonomy) and not names.generate_names_index(lake, target, None, taxonomy)
    for pair in lake.pairs():
        ours = {tuple(r) for r in names.load_names_index(spark, target, pair, RELEASE).collect()}
        assert ours == {tuple(r) for r in names.all_paths(lake, pair, RELEASE, taxonomy).collect()}
    assert {r.category for r in names.load_names_index(spark, target, ("places", "place"), RELEASE).collect()} == {"cafe", "bar", "museum"}


def test_geoparquet_files(lake, tmp_path):
    box = Geometry.box(-1, -1, 10, 10)
    path = api.download_data("base", "water", box, working_directory=tmp_path, row_group_size=30)
    meta = pq.read_metadata(path)
    assert json.loads(meta.metadata[b"geo"])["primary_column"] == "geometry" and meta.num_rows == 100
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [30, 30, 30, 10]
    assert meta.row_group(0).column(0).compression == "ZSTD"
    before = path.stat().st_mtime_ns
    assert api.download_data("base", "water", box, working_directory=tmp_path, row_group_size=30).stat().st_mtime_ns == before
    assert api.download_data("base", "water", box, working_directory=tmp_path, sort_result=False) != path
    frame = api.convert_bounding_box_to_geodataframe("base", "water", (2, 2, 5, 5), columns_to_download=["n"], working_directory=tmp_path)
    assert frame.index.name == "id" and len(frame) == 4 and frame["geometry"].iloc[0].bounds[0] in (3, 4)
    with pytest.raises(ValueError):
        api.download_data_for_multiple_types([("base", "water")], box, pyarrow_filter=[None, None])
    gone = api.convert_bounding_box_to_parquet("base", "water", (50, 50, 51, 51), working_directory=tmp_path)
    assert pq.read_metadata(gone).num_rows == 0 and "class" in pq.read_schema(gone).names
    out = sink.write_dataset(lake.read("base", "water"), f"file://{tmp_path}/set")
    assert lake.spark.read.parquet(out).count() == 100


def test_wide_forms(lake, tmp_path):
    box = Geometry.box(-1, -1, 10, 10)
    all_names = api.get_all_possible_column_names()
    frame = api.convert_geometry_to_wide_form_geodataframe_for_all_types(box, working_directory=tmp_path)
    assert list(frame.columns) == ["geometry", *all_names]
    water = api.convert_bounding_box_to_wide_form_geodataframe("base", "water", (-1, -1, 10, 10), working_directory=tmp_path)
    assert set(water.columns[1:]) == {n for n in all_names if n.startswith("base|water")} and (water.iloc[:, 1:].sum(axis=1) == 1).all()
    pruned = api.convert_geometry_to_wide_form_geodataframe("base", "water", box, pyarrow_filter=[("subtype", "=", "lake")], include_all_possible_columns=False, working_directory=tmp_path)
    assert set(pruned.columns[1:]) == {"base|water|lake", "base|water|lake|big"}
    assert api.get_all_possible_column_names(theme="base", type="water", hierarchy_depth=1) == ["base|water", "base|water|lake", "base|water|river"]
    assert api.get_all_possible_column_names(theme="base", type="water", hierarchy_depth=0) == ["base|water"]
    places = api.wide_features([("places", "place")], box, places_minimal_confidence=0.5)
    assert set(places.names) == {"places|place|eat|cafe", "places|place|eat|bar", "places|place|museum"}
    assert places.unpacked().count() == 50  # from 0.5 on
    low = api.wide_features([("places", "place")], box, places_minimal_confidence=0.0)
    assert low.unpacked().count() == 98  # null categories and NaN are out
    one = api.wide_features([("places", "place")], box, places_use_primary_category_only=True).unpacked().drop("bbox", "geometry", "id").toPandas()
    assert (one.sum(axis=1) == 1).all()
    few = api.wide_features([("places", "place")], box, include_all_possible_columns=False, places_use_primary_category_only=True)
    assert set(few.names) == {"places|place|eat|cafe", "places|place|museum"}
    with pytest.raises(ValueError):
        api.get_all_possible_column_names(theme="base")
    with pytest.raises(ValueError):
        api.wide_features([("base", "water")], box, hierarchy_depth=[1, 2])


def test_wide_rules(spark):
    assert W.checked_depth(None, 3) == 3 and W.checked_depth(2, 3) == 2
    with pytest.raises(NegativeHierarchyDepthError):
        W.checked_depth(-1, 3)
    with pytest.warns(HierarchyDepthOutOfBoundsWarning):
        assert W.checked_depth(9, 3) == 3
    assert W.hierarchies("2024-05-01.0")["buildings", "building"] == ("class",) and ("base", "land_cover") not in W.hierarchies("2024-05-01.0")
    assert W.hierarchies("2024-06-01.0")["transportation", "segment"] == ("subtype", "class")
    gaps = spark.createDataFrame([("a", None, "x"), ("b", "s", "x"), ("c", None, None)], "id string, subtype string, class string")
    packed = W.standard(gaps, ("base", "water"), keep=("id",))
    assert packed.names == ("base|water", "base|water|s|x")  # a gap ends the name
    assert {r.id: r["base|water"] for r in packed.unpacked().collect()} == {"a": True, "b": False, "c": True}
    many = spark.range(50).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("k.`"), (F.col("id") * 7 % 300).cast("string")).alias("subtype"), F.lit(None).cast("string").alias("class"))
    universe = spark.range(300).select(F.concat(F.lit("k.`"), F.col("id").cast("string")).alias("subtype"), F.lit(None).cast("string").alias("class"))
    wide = W.standard(many, ("base", "water"), None, universe, ("id",))  # over the native limit
    flat = wide.unpacked()
    assert len(flat.columns) == 301 and flat.toPandas().set_index("id").sum(axis=1).eq(1).all()
    counts = {r.column_name: r.n for r in wide.counts().collect()}
    assert sum(counts.values()) == 50 and len(counts) == 300


def test_taxonomy_file(spark, lake):
    t = read_taxonomy(spark, f"{lake.root}/taxonomy.csv", 2)
    assert {tuple(r) for r in t.collect()} == {("cafe", "eat", "cafe"), ("bar", "eat", "bar")}


def test_streamed_extract(spark, lake, tmp_path):
    folder = lake.folder("base", "water")
    stream = feature_stream(spark, folder, spark.read.parquet(folder).schema, 1)
    extract_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state", Geometry.box(2, 2, 5, 5), [("n", ">", 0)], ["n"]).awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4


def test_regions_from_text(tmp_path):
    assert regions.from_bbox("1, 2,3,4").bounds == (1, 2, 3, 4)
    (tmp_path / "r.geojson").write_text('{"type": "Point", "coordinates": [1, 2]}')
    (tmp_path / "r.wkt").write_text("POINT (1 2)\nPOINT (3 4)\n")
    assert regions.from_file(str(tmp_path / "r.geojson")).bounds == (1, 2, 1, 2) and regions.from_file(str(tmp_path / "r.wkt")).bounds == (1, 2, 3, 4)
    for make, bad in ((regions.from_bbox, "1,2,3"), (regions.from_bbox, "a,b,c,d"), (regions.from_wkt, "x"), (regions.from_geojson, "{"), (regions.from_geohash, "ai"), (regions.from_s2, "zz"), (regions.from_file, "/none")):
        with pytest.raises(BadParameter):
            make(bad)
    with pytest.raises(NotImplementedError):
        regions.geocode("Monaco", str(tmp_path))


def test_command_line(spark, lake, tmp_path, capsys):
    base = ["--root", lake.root, "--work-dir", str(tmp_path)]
    assert cli.main(["base", "water", *base, "--geom-filter-bbox", "2,2,5,5", "--filter", "n > 33", "--no-sort"], spark) == 0
    path = capsys.readouterr().out.strip()
    assert pq.read_metadata(path).num_rows == 3
    assert cli.main([*base, "--show-theme-type-pairs"], spark) == 0 and "base|water" in capsys.readouterr().out
    assert cli.main([*base, "--show-release-versions"], spark) == 0 and RELEASE in capsys.readouterr().out
    assert cli.main(["base", "water", *base, "--geom-filter-index-h3", "8059fffffffffff"], spark) == 0 and capsys.readouterr().out
    box = ["--geom-filter-bbox", "1,1,2,2"]
    wrong = (
        ["base", "water", *base],
        ["base", "none", *base, *box],
        ["base", "water", *base, *box, "--geom-filter-wkt", "POINT (1 1)"],
        ["base", "water", *base, "--geom-filter-index-h3", "8a3969a40ac7ff"],
        ["base", "water", *base, *box, "--silent", "--transient"],
        ["base", "water", *base, "--geom-filter-bbox", "x"],
        ["base", *base],
    )
    for argv in wrong:
        assert cli.main(argv, spark) == 2
    api.configure(spark, lake.root, None, f"{lake.root}/taxonomy.csv")
