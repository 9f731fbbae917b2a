"""Pairs of features of two tables that meet, by grid cells of many sizes.

A feature lies on the level whose cells are just as large as its box, so it
touches four of them at most.  It is dealt to these, and on each coarser level
that the other table has features on, to the cells its box touches there; a pair
meets on the coarser of its two levels, in the cell that holds the lower corner
of what both boxes share, and so once.  No side has to be small.

Cells with many rows are split: rows of a crowded cell are numbered off into
parts, and each part meets every part of the other table there.  The table of
crowded cells has CROWDED_CELLS rows at most, as a cell counts as crowded from
that share of all rows on (and PART rows at least), and is broadcast.

Defined results: boxes are closed, so touching counts; rows without a box or
with NaN in it meet nothing; rows that repeat are rows of their own; empty
tables give no pairs.  Columns come as two structs, so names can't clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import Geometry
from quadrille.functions.intersects import intersects, points_in
from quadrille.operators.extract import BBOX, GEOMETRY

#: Levels of cells: 360 degrees halved this many times at most.
LEVELS = 24
#: Rows of a part of a crowded cell, and rows of the table of crowded cells, at most.
PART, CROWDED_CELLS = 100_000, 1_000_000
_CELL = ("level", "cx", "cy")


def _side(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _cell(value: Column, level: Column) -> Column:
    return F.floor((value + 180.0) / _side(level))


def _with_level(df: DataFrame, name: str) -> DataFrame:
    """The rows as one struct, with their box and own level."""
    box = F.col(f"{name}.{BBOX}")
    extent = F.greatest(box.xmax - box.xmin, box.ymax - box.ymin).cast("double")
    own = F.when(extent <= 360.0 / 2**LEVELS, LEVELS).otherwise(F.greatest(F.floor(F.log2(F.lit(360.0) / extent)), F.lit(0))).cast("int")
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
    sound = [~F.isnan(box[k].cast("double")) & box[k].isNotNull() for k in ("xmin", "xmax", "ymin", "ymax")]
    return whole.where(reduce(Column.__and__, sound)).select(name, own.alias("own"))


def _dealt(rows: DataFrame, name: str, levels: list[int], finest: int) -> DataFrame:
    """A row for each cell of each level that counts: `up` where the level is coarser than the row's own."""
    clipped = rows.select(name, F.least("own", F.lit(finest)).alias("own"))
    coarser = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x < F.col("own"))
    at = clipped.select(name, "own", F.explode(F.array_append(coarser, F.col("own"))).alias("level"))
    box, level = F.col(f"{name}.{BBOX}"), F.col("level")
    spans = [F.sequence(_cell(box[f"{v}min"].cast("double"), level), _cell(box[f"{v}max"].cast("double"), level)) for v in "xy"]
    wide = at.select(name, "level", (level < F.col("own")).alias("up"), F.explode(spans[0]).alias("cx"), spans[1].alias("ys"))
    return wide.select(name, *_CELL[:2], F.explode("ys").alias("cy"), "up")


def _crowded(dealt: DataFrame, rows: int, part: int) -> DataFrame:
    """Cells with more rows than fit a part, and their number of parts."""
    size = max(part, rows // CROWDED_CELLS + 1)
    counted = dealt.groupBy(*_CELL).agg(F.count("*").alias("n")).where(F.col("n") > size)
    return counted.select(*_CELL, F.ceil(F.col("n") / size).cast("int").alias("parts"))


def _split(dealt: DataFrame, own: DataFrame, other: DataFrame, mine: str, theirs: str) -> DataFrame:
    """Each row in one part of its cell, for every part of the other table there."""
    joined = dealt.join(F.broadcast(own.withColumnRenamed("parts", "_own")), list(_CELL), "left").join(F.broadcast(other.withColumnRenamed("parts", "_other")), list(_CELL), "left")
    part = F.when(F.col("_own").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_own"))).cast("int")
    numbered = joined.withColumn(mine, part)  # before rows are repeated, as a row keeps its part
    return numbered.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("_other", F.lit(1)) - 1)).alias(theirs)).drop("_own", "_other")


def spatial_join(left: DataFrame, right: DataFrame, exact: bool = False, part: int = PART) -> DataFrame:
    """(left, right) structs of the rows whose boxes share a point; `exact`: whose geometries do.

    Both tables have a bbox struct; `exact` reads their geometry columns (WKB).
    """
    rows = {"left": _with_level(left, "left"), "right": _with_level(right, "right")}
    # One row for each level: 25 at most.
    known = {k: {r.own: r.n for r in df.groupBy("own").agg(F.count("*").alias("n")).collect()} for k, df in rows.items()}
    if not all(known.values()):
        return rows["left"].select("left").join(rows["right"].select("right"), F.lit(False))
    finest = min(max(v) for v in known.values())
    levels = {k: sorted({min(x, finest) for x in v}) for k, v in known.items()}
    a, b = _dealt(rows["left"], "left", levels["right"], finest), _dealt(rows["right"], "right", levels["left"], finest)
    many_a, many_b = (_crowded(x, sum(known[k].values()), part) for k, x in (("left", a), ("right", b)))
    a, b = _split(a, many_a, many_b, "_a", "_b"), _split(b, many_b, many_a, "_b", "_a")
    pairs = a.join(b.withColumnRenamed("up", "up_b"), [*_CELL, "_a", "_b"]).where(~(F.col("up") & F.col("up_b")))
    p, q = F.col(f"left.{BBOX}"), F.col(f"right.{BBOX}")
    meet = reduce(Column.__and__, [(p[f"{v}min"] <= q[f"{v}max"]) & (q[f"{v}min"] <= p[f"{v}max"]) for v in "xy"])
    once = reduce(Column.__and__, [_cell(F.greatest(p[f"{v}min"].cast("double"), q[f"{v}min"].cast("double")), F.col("level")) == F.col(f"c{v}") for v in "xy"])
    found = pairs.where(meet & once).select("left", "right")
    return found.where(_geometries_meet(F.col(f"left.{GEOMETRY}"), F.col(f"right.{GEOMETRY}"))) if exact else found


def _geometries_meet(left: Column, right: Column) -> Column:
    """Whether two WKB columns share a point; a geometry that stands in several rows is read once, and its points tested at once."""

    @F.pandas_udf("boolean")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(left), bool)
        sides = [left.map(lambda v: None if v is None else bytes(v)), right.map(lambda v: None if v is None else bytes(v))]
        one, other = sides if sides[0].nunique() >= sides[1].nunique() else sides[::-1]
        for raw, at in other.groupby(other, sort=False).groups.items():
            shape, rest = Geometry.from_wkb(raw), one.loc[at].dropna()
            point = rest.map(lambda v: len(v) == 21 and v[:5] == b"\x01\x01\x00\x00\x00")
            if point.any():
                flat = np.frombuffer(b"".join(v[5:] for v in rest[point]), "<f8").reshape(-1, 2)
                out[rest.index[point]] = points_in(flat, shape)
            for i, v in rest[~point].items():
                out[i] = intersects(Geometry.from_wkb(v), shape)
        return pd.Series(out)

    return run(left, right)
