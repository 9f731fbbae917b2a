"""The index of wide-form columns: all paths of each table of a release, written once, so that no query has to look for them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import wide as W
from quadrille.sources.index import _write_text, digest
from quadrille.sources.lake import Lake, listed
from quadrille.sources.taxonomy import read_taxonomy

CATALOG = "wide_form_columns.json"
#: Fixed value: the release that renamed the primary category of places.
RENAMED = "2024-07-22.0"


def primary_name(release: str) -> str:
    return "primary" if release >= RENAMED else "main"


def all_paths(lake: Lake, pair: tuple[str, str], release: str, taxonomy: str | None = None) -> DataFrame:
    """All paths of a table: its distinct levels, or for places the taxonomy and the categories it lacks."""
    table = lake.read(*pair, release)
    if pair != W.PLACES:
        levels = W.hierarchies(release)[pair]
        return table.select(*levels).distinct().orderBy(*[F.asc_nulls_last(c) for c in levels])
    seen = W.observed_categories(table, primary_name(release))
    if taxonomy is None:
        return seen.select("category", F.col("category").alias("1"))
    return W.backfilled(read_taxonomy(lake.spark, taxonomy), seen)


def generate_names_index(lake: Lake, target: str, release: str | None = None, taxonomy: str | None = None, ignore_cache: bool = False) -> bool:
    """Writes the paths of every classified table under `target`; False if they were there already."""
    release = lake.resolved(release)
    base = f"{target}/{release}"
    if not ignore_cache and any(n == CATALOG for n, _, _ in listed(lake.spark, base)):
        return False
    there, content = set(lake.pairs(release)), []
    for pair in sorted(set(W.hierarchies(release)) & there):
        folder = f"{base}/{'_'.join(pair)}_columns.parquet"
        all_paths(lake, pair, release, taxonomy).coalesce(1).write.mode("overwrite").parquet(folder)
        content.append({"theme": pair[0], "type": pair[1], "sha": digest(lake.spark, folder)})
    _write_text(lake.spark, f"{base}/{CATALOG}", json.dumps(content))
    return True


def checked_names_index(spark: SparkSession, target: str, release: str) -> bool:
    """Whether an index of names is there and whole; a changed table raises."""
    base = f"{target}/{release}"
    if not any(n == CATALOG for n, _, _ in listed(spark, base)):
        return False
    for entry in json.loads("".join(r[0] for r in spark.read.text(f"{base}/{CATALOG}").collect())):
        if digest(spark, f"{base}/{entry['theme']}_{entry['type']}_columns.parquet") != entry["sha"]:
            raise ValueError(f"checksum of the names of {entry['theme']}/{entry['type']} differs")
    return True


def load_names_index(spark: SparkSession, target: str, pair: tuple[str, str], release: str) -> DataFrame:
    """The paths of one table as they were written."""
    return spark.read.parquet(f"{target}/{release}/{'_'.join(pair)}_columns.parquet")
