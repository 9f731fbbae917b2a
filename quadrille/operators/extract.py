"""Spatial extracts: rows of a feature table whose geometry meets a region.

The box test compares the bbox struct, strictly, with native expressions that
reach the Parquet scan.  For regions that are no rectangle a covering decides
natively what lies in a cell inside or outside; the exact test gets the
geometries of the rest alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.errors import MissingColumnError
from quadrille.functions.covering import BORDER, INSIDE, OUTSIDE, covered_intersects, covering
from quadrille.functions.geometry import Geometry
from quadrille.plans.predicate import Predicate, compiled

ID, GEOMETRY, BBOX = "id", "geometry", "bbox"


def in_box(bounds: tuple[float, float, float, float], bbox: str = BBOX) -> Column:
    """Whether the row's box overlaps the given one; boxes that only touch do not."""
    xmin, ymin, xmax, ymax = bounds
    side = lambda name: F.col(f"{bbox}.{name}")
    return (side("xmin") < xmax) & (side("xmax") > xmin) & (side("ymin") < ymax) & (side("ymax") > ymin)


def touches_box(bounds: tuple[float, float, float, float], bbox: str = BBOX) -> Column:
    """The closed test that row-group indexes use: touching counts."""
    xmin, ymin, xmax, ymax = bounds
    side = lambda name: F.col(f"{bbox}.{name}")
    return (side("xmin") <= xmax) & (side("xmax") >= xmin) & (side("ymin") <= ymax) & (side("ymax") >= ymin)


def projected(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The wanted columns, id and geometry, in the table's order; none or None: all."""
    if not columns:
        return df
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumnError(f"Cannot download given columns: {', '.join(missing)}")
    wanted = {*columns, ID, GEOMETRY}
    return df.select(*[f"`{c}`" for c in df.columns if c in wanted])


def extract(features: DataFrame, region: Geometry | None = None, where: Predicate | None = None, columns: Sequence[str] | None = None, exact: bool | None = None) -> DataFrame:
    """Rows in the region that satisfy the predicate.

    exact None: the exact test runs unless the region is a rectangle, for which
    overlapping boxes are enough; True or False force it on or off.
    """
    df = features
    if region is not None:
        df = df.where(in_box(region.bounds))
    test = compiled(where, features.schema)
    if test is not None:
        df = df.where(test)
    if region is not None and (not region.is_rectangle if exact is None else exact):
        df = _exact(df, region)
    return projected(df, columns)


def _exact(df: DataFrame, region: Geometry) -> DataFrame:
    """Rows whose geometry meets the region; geometries that the covering decides don't go to Python."""
    side = df.schema[BBOX].dataType["xmin"].dataType
    cover = covering(region, float_boxes=isinstance(side, T.FloatType))
    kind = "kind-" + uuid.uuid4().hex
    told = df.withColumn(kind, cover.kind(BBOX)).where(F.col(kind) != OUTSIDE)
    unsure = F.when(F.col(kind) == BORDER, F.col(GEOMETRY))
    return told.where((F.col(kind) == INSIDE) & F.col(GEOMETRY).isNotNull() | covered_intersects(unsure, cover)).drop(kind)
