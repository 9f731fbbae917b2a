"""The row-group source: what it reads, and that its tests mean what Spark's do."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quadrille.functions.geometry import Geometry
from quadrille.sources.grouped import grouped_extract
from quadrille.sources.index import row_group_rows


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Three files of several row groups with null and NaN in every column; (folder, units)."""
    folder = str(tmp_path_factory.mktemp("grouped") / "t")
    rows = [(i, None if i % 11 == 0 else math.nan if i % 7 == 0 else i / 10, None if i % 5 == 0 else f"n{i % 13}", None if i % 17 == 0 else i % 3 == 0, None if i % 19 == 0 else {"xmin": i / 10, "xmax": i / 10, "ymin": 1.0, "ymax": 2.0}, b"x", [i], i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, s string, b boolean, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, geometry binary, arr array<long>, n int")
    df.repartitionById(3, F.expr("cast(id div 1000 as int)")).sortWithinPartitions("id").write.option("parquet.block.row.count.limit", 250).parquet(folder)
    files = [r[0] for r in spark.read.parquet(folder).select("_metadata.file_path").distinct().collect()]
    return folder, sorted((r.filename, r.row_group) for r in row_group_rows(spark, files).collect())


TESTS = ["x > 50", "x >= 299.8", "x < 3", "x <= 3", "x = 4.1", "x <> 4.1", "NOT (x > 50)", "NOT (x <= 50)", "x = double('NaN')", "s = 'n3'", "s <> 'n3'", "s in ('n1', 'n2')", "s in ('n1', null)", "NOT s in ('n1', 'n2')", "NOT s in ('n1', null)", "s like 'n1%'", "s like '%3'", "s like '%1%'", "NOT s like 'n1%'", "s is null", "s is not null", "s <=> 'n4'", "NOT (s <=> 'n4')", "s <=> null", "b", "NOT b", "n >= 2990", "bbox.xmin > 299", "bbox is null", "x > 290 or s = 'n1'", "n > 5000000000", "x > 10 and s = 'n5' and n % 2 = 0"]


@pytest.mark.parametrize("test", TESTS)
def test_pushed_tests_mean_the_same(spark, table, test):
    folder, units = table
    whole = spark.read.parquet(folder)
    found = sorted(r.id for r in grouped_extract(whole, units, where=test, columns=["s"]).collect())
    assert found == sorted(r.id for r in whole.where(test).collect())


def test_only_kept_groups_and_needed_columns_are_read(spark, table, tmp_path):
    folder, units = table
    (tmp_path / "trace").mkdir()
    whole, box, some = spark.read.parquet(folder), Geometry.box(20, 0, 60, 3), units[1:6]
    df = grouped_extract(whole, some, box, [("s", "in", ["n1", "n2"])], ["s"], trace=f"file://{tmp_path}/trace")
    assert df.columns == ["id", "s", "geometry"]
    assert df.rdd.getNumPartitions() == 5
    expected = whole.where("_metadata.file_path is not null").where("bbox.xmin < 60 and bbox.xmax > 20 and s in ('n1', 'n2') and id >= 250 and id < 1500")
    assert sorted(r.id for r in df.collect()) == sorted(r.id for r in expected.select("id").collect())
    told = [json.loads(p.read_text()) for p in (tmp_path / "trace").iterdir()]
    assert sorted((t["file"], t["row_group"]) for t in told) == some
    assert {tuple(t["columns"]) for t in told} == {("id", "s", "bbox", "geometry")}
    assert sum(t["rows"] for t in told) == expected.count()  # the scanner drops the others


def test_all_types_and_no_columns(spark, table):
    folder, units = table
    whole = spark.read.parquet(folder)
    same = lambda df: sorted(map(str, df.collect()))
    assert same(grouped_extract(whole, units)) == same(whole)
    assert grouped_extract(whole, units).count() == 3000
    none = grouped_extract(whole, [], columns=["s"])
    assert none.columns == ["id", "s", "geometry"] and none.count() == 0
