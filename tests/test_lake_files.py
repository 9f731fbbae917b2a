"""The lake's tables in several files a quarter: row groups keep the numbers that SQL gives them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quadrille import catalogue, catalogue_lake
from quadrille.sources import index

SF = "/root/testdata/sf0.01"


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(catalogue_lake, "PER_FILE", 3, raising=False)


def test_no_file_is_longer_than_its_row_groups(spark, short):
    lake = catalogue_lake._lake(spark, SF, catalogue_lake.LAND)
    rows = index.row_group_rows(spark, lake.files(*catalogue_lake.LAND, catalogue_lake.RELEASE)).groupBy("filename").agg(F.sum("rows").alias("n"), F.count("*").alias("groups")).collect()
    assert sum(r.n for r in rows) == 60_000
    assert len(rows) == 12 and max(r.groups for r in rows) == 3 and max(r.n for r in rows) == 6_000


@pytest.mark.parametrize("name", ["index_in_order", "index_pruned_groups", "index_of_several_tables", "lake_groups_read", "row_group_map"])
def test_numbers_are_those_of_sql(spark, short, monkeypatch, name):
    if name not in ("index_in_order", "index_pruned_groups"):
        monkeypatch.setattr(catalogue_lake, "PER_FILE", 1, raising=False)  # a quarter of these tables has two row groups
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = catalogue.queries()[name](spark, SF)
    theirs = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs)
