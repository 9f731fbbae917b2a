"""Wide form: one boolean column for each category path of a hierarchy.

Rows carry the indexes of their true columns as an array of int through unions
and sorts; thousands of boolean columns are made once, at the end.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.errors import HierarchyDepthOutOfBoundsWarning, NegativeHierarchyDepthError

#: Hierarchy columns of each theme and type.
HIERARCHIES: dict[tuple[str, str], tuple[str, ...]] = {
    ("base", "infrastructure"): ("subtype", "class"),
    ("base", "land"): ("subtype", "class"),
    ("base", "land_cover"): ("subtype",),
    ("base", "land_use"): ("subtype", "class"),
    ("base", "water"): ("subtype", "class"),
    ("buildings", "building"): ("subtype", "class"),
    ("places", "place"): ("1", "2", "3", "4", "5", "6"),
    ("transportation", "segment"): ("subtype", "class", "subclass"),
}
PLACES = ("places", "place")
#: Up to so many columns come from native expressions, more from one Arrow scatter.
NATIVE_COLUMNS = 200
INDEXES = "column_indexes"
#: Paths up to which they are sent to every executor (some 10 MB), so that features are not shuffled.
BROADCAST_PATHS = 100_000


def hierarchies(release: str | None = None) -> dict[tuple[str, str], tuple[str, ...]]:
    """The hierarchy columns that a release has; None: the newest."""
    found = dict(HIERARCHIES)
    if release is not None and release < "2024-08-20.0":
        found["transportation", "segment"] = ("subtype", "class")
    if release is not None and release < "2024-05-16-beta.0":
        found["buildings", "building"] = ("class",)
        del found["base", "land_cover"]
    return found


def checked_depth(depth: int | None, levels: int) -> int:
    """The number of levels to use."""
    if depth is None:
        return levels
    if depth < 0:
        raise NegativeHierarchyDepthError(f"Hierarchy depth cannot be negative: {depth}")
    if depth > levels:
        warnings.warn(f"Hierarchy depth {depth} is over the {levels} levels there are", HierarchyDepthOutOfBoundsWarning, stacklevel=2)
        return levels
    return depth


def path_name(prefix: str, columns: Sequence[str]) -> Column:
    """prefix|a|b|..., up to the first null level."""
    name, open_ = F.lit(prefix), F.lit(True)
    for c in columns:
        open_ = open_ & F.col(f"`{c}`").isNotNull()
        name = F.when(open_, F.concat(name, F.lit("|"), F.col(f"`{c}`"))).otherwise(name)
    return name


def definitions(levels: DataFrame, pair: tuple[str, str], columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """column_name with its levels (and `keep`), each once, by name; `levels` may repeat."""
    prefix = "|".join(pair)
    return levels.select(*keep, *[f"`{c}`" for c in columns]).distinct().select(path_name(prefix, columns).alias("column_name"), *keep, *[f"`{c}`" for c in columns]).orderBy("column_name", *keep, *[F.asc_nulls_last(f"`{c}`") for c in columns])


def column_names(definition: DataFrame) -> list[str]:
    """The distinct names, sorted: as many as the wide table has columns."""
    return sorted(r[0] for r in definition.select("column_name").distinct().collect())


@dataclass(frozen=True)
class Packed:
    """`rows`: the kept columns and INDEXES, which count into `names`."""

    rows: DataFrame
    names: tuple[str, ...]

    def renumbered(self, names: Sequence[str]) -> DataFrame:
        """The rows with indexes into a larger list of names."""
        place = {n: i for i, n in enumerate(names)}
        moved = [place[n] for n in self.names]
        if moved == list(range(len(moved))):
            return self.rows
        table = F.array(*[F.lit(i) for i in moved])
        return self.rows.withColumn(INDEXES, F.transform(INDEXES, lambda i: F.get(table, i)))

    def unpacked(self) -> DataFrame:
        """One boolean column for each name, never null."""
        return unpacked(self.rows, self.names)

    def counts(self) -> DataFrame:
        """column_name and n, its true rows; columns without any count 0."""
        numbered = self.rows.sparkSession.createDataFrame(list(enumerate(self.names)), "i int, column_name string")
        n = self.rows.select(F.explode(INDEXES).alias("i")).groupBy("i").count()
        return numbered.join(n, "i", "left").select("column_name", F.coalesce("count", F.lit(0)).alias("n"))


def unpacked(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The packed rows' other columns, then a boolean column for each name."""
    others = [c for c in rows.columns if c != INDEXES]
    if len(names) <= NATIVE_COLUMNS:
        return rows.select(*[f"`{c}`" for c in others], *[F.coalesce(F.array_contains(INDEXES, F.lit(i)), F.lit(False)).alias(n) for i, n in enumerate(names)])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != INDEXES]
    schema = ", ".join([*kinds, *(f"`{n.replace('`', '``')}` boolean" for n in names)])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                at = batch.schema.get_field_index(INDEXES)
                lists = batch.column(at).fill_null([])
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flags = np.zeros((len(names), batch.num_rows), bool)
                flags[lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), sizes)] = True
                own = [batch.column(i) for i in range(batch.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, flags)], [*others, *names])

    return rows.mapInArrow(scatter, schema)


def packed(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """The boolean columns in `names` as one array of the indexes that are true."""
    flags = F.array(*[F.when(F.col(f"`{n}`"), F.lit(i)) for i, n in enumerate(names)]) if names else F.array().cast("array<int>")
    return wide.select(*[f"`{c}`" for c in wide.columns if c not in set(names)], F.array_compact(flags).alias(INDEXES))


def standard(features: DataFrame, pair: tuple[str, str], depth: int | None = None, definition: DataFrame | None = None, keep: Sequence[str] = ("id", "geometry"), columns: Sequence[str] | None = None) -> Packed:
    """The packed wide form of a table with one path per row.

    definition None: only paths that occur; else all of its paths.  Levels
    compare null-safe: a null level matches a null level alone.  Depth 0 is
    one column that is true for every row.
    """
    levels = tuple(columns or HIERARCHIES[pair])
    levels = levels[: checked_depth(depth, len(levels))]
    kept = [f"`{c}`" for c in keep]
    if not levels:
        return Packed(features.select(*kept, F.array(F.lit(0)).alias(INDEXES)), ("|".join(pair),))
    # One row for each path: as many as the table has columns, or a few more.
    paths = definitions(features if definition is None else definition, pair, levels).collect()
    names = sorted({r["column_name"] for r in paths})
    place = {n: i for i, n in enumerate(names)}
    kinds = ", ".join(["i int", *(f"_{j} {(features if definition is None else definition).schema[c].dataType.simpleString()}" for j, c in enumerate(levels))])
    keyed = features.sparkSession.createDataFrame([(place[r["column_name"]], *(r[c] for c in levels)) for r in paths], kinds)
    if len(paths) <= BROADCAST_PATHS:
        keyed = F.broadcast(keyed)
    same = reduce(Column.__and__, [features[f"`{c}`"].eqNullSafe(keyed[f"_{j}"]) for j, c in enumerate(levels)])
    rows = features.join(keyed, same, "left").select(*kept, F.array_compact(F.array("i")).alias(INDEXES))
    return Packed(rows, tuple(names))


def places(features: DataFrame, definition: DataFrame, depth: int | None = None, primary_only: bool = False, min_confidence: float | None = 0.75, keep: Sequence[str] = ("id", "geometry"), primary: str = "primary", pair: tuple[str, str] = PLACES) -> Packed:
    """The packed wide form of places, whose rows have a primary category and alternates.

    `definition`: category and its levels "1", "2", ...; several categories
    may share a column.  A row is true in the columns of all its categories,
    or of the primary one.  Rows without categories or below the confidence
    are left out.
    """
    test = F.col("categories").isNotNull()
    if min_confidence is not None:
        test = test & (F.col("confidence") >= min_confidence) & ~F.isnan("confidence")
    rows = features.where(test)
    levels = [c for c in definition.columns if c != "category"]
    levels = levels[: checked_depth(depth, len(levels))]
    kept = [f"`{c}`" for c in keep]
    if not levels:
        return Packed(rows.select(*kept, F.array(F.lit(0)).alias(INDEXES)), ("|".join(pair),))
    paths = definitions(definition, pair, levels, keep=("category",))
    names = column_names(paths)
    place = {n: i for i, n in enumerate(names)}
    # One row for each category of the taxonomy, which is as bounded as the table's columns.
    index = {r["category"]: place[r["column_name"]] for r in paths.select("category", "column_name").collect()}
    own = F.array(F.col(f"categories.{primary}"))
    listed = own if primary_only else F.concat(own, F.coalesce(F.col("categories.alternate"), F.array().cast("array<string>")))
    return Packed(rows.select(*kept, _indexed(listed, index).alias(INDEXES)), tuple(names))


def _indexed(categories: Column, index: dict[str, int]) -> Column:
    """The columns of the listed categories, each once, in one vectorised look-up."""
    keys = pa.array(list(index), pa.string())
    values = np.array(list(index.values()), np.int32)

    @F.arrow_udf("array<int>")
    def run(lists: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        lists = lists.fill_null([])
        at = pc.index_in(lists.flatten(), value_set=keys)
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))[hit]
        # Duplicates of a row fall together when row and column sort as one number.
        both = np.unique(row.astype(np.int64) << 32 | values[at.drop_null().to_numpy()])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(both >> 32, minlength=len(lists)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((both & 0xFFFFFFFF).astype(np.int32)))

    return run(categories)


def observed_categories(features: DataFrame, primary: str = "primary", primary_only: bool = False) -> DataFrame:
    """category: every primary and, unless left out, alternate category that occurs, once; no null."""
    found = features.select(F.col(f"categories.{primary}").alias("category"))
    if not primary_only:
        found = found.union(features.select(F.explode("categories.alternate")))
    return found.distinct().na.drop().orderBy("category")


def backfilled(taxonomy: DataFrame, observed: DataFrame) -> DataFrame:
    """The taxonomy (category, "1", "2", ...) and, as paths of depth 1, observed categories that it lacks."""
    unseen = observed.join(taxonomy, "category", "left_anti").select("category", F.col("category").alias("1"))
    return taxonomy.unionByName(unseen, allowMissingColumns=True)


def united(parts: Sequence[Packed]) -> Packed:
    """All rows of all parts, over the sorted union of their names."""
    names = tuple(sorted({n for p in parts for n in p.names}))
    return Packed(reduce(DataFrame.unionByName, [p.renumbered(names) for p in parts]), names)


def union_by_name(tables: Sequence[DataFrame], keep: Sequence[str] = ("id", "geometry")) -> DataFrame:
    """Union of wide tables by column name; a column that a table lacks is False in its rows."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    names = sorted(set(whole.columns) - set(keep))
    return whole.select(*[f"`{c}`" for c in keep], *[F.coalesce(F.col(f"`{n}`"), F.lit(False)).alias(n) for n in names])
