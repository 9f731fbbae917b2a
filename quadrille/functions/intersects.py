"""The closed intersects predicate, vectorised over a column of WKB geometries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.geometry import Geometry
from quadrille.functions.robust import orientation

#: Cells of one points-by-edges matrix.
_CELLS = 1 << 22


def on_segments(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each point, whether it lies on any edge, ends included."""
    out = np.zeros(len(points), bool)
    step = max(1, _CELLS // max(1, len(edges)))
    for i in range(0, len(points), step):
        out[i : i + step] = _beside(points[i : i + step], edges)[1].any(1)
    return out


def _beside(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point and edge: whether the edge passes to the right of the point, and whether the point lies on it.

    Orientation is asked only of edges whose range of y holds the point.
    """
    x, y = points[:, :1], points[:, 1:]
    x0, y0, x1, y1 = edges.T
    level = (np.minimum(y0, y1) <= y) & (y <= np.maximum(y0, y1))
    i, j = np.nonzero(level & (x <= np.maximum(x0, x1)))
    sign = orientation(x0[j], y0[j], x1[j], y1[j], points[i, 0], points[i, 1])
    passes, holds = np.zeros(level.shape, bool), np.zeros(level.shape, bool)
    up = y1[j] > y0[j]
    passes[i, j] = ((y0[j] > points[i, 1]) != (y1[j] > points[i, 1])) & (sign == np.where(up, 1, -1))
    holds[i, j] = (sign == 0) & (np.minimum(x0[j], x1[j]) <= points[i, 0])
    return passes, holds


def in_polygon(points: np.ndarray, rings: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each point, whether it lies in the polygon or on its border; holes are open."""
    edges = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
    out = np.zeros(len(points), bool)
    step = max(1, _CELLS // max(1, len(edges)))
    for i in range(0, len(points), step):
        passes, holds = _beside(points[i : i + step], edges)
        out[i : i + step] = (passes.sum(1) % 2 == 1) | holds.any(1)
    return out


def segments_meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any edge of `a` meets any edge of `b`, ends included."""
    step = max(1, _CELLS // max(1, len(b)))
    low, high = np.minimum(b[:, :2], b[:, 2:]), np.maximum(b[:, :2], b[:, 2:])
    for k in range(0, len(a), step):
        part = a[k : k + step]
        least, most = np.minimum(part[:, :2], part[:, 2:]), np.maximum(part[:, :2], part[:, 2:])
        i, j = np.nonzero(((least[:, None] <= high) & (low <= most[:, None])).all(2))
        if not len(i):
            continue
        p, q = part[i].T, b[j].T
        across = (orientation(*p, q[0], q[1]) * orientation(*p, q[2], q[3]) <= 0) & (orientation(*q, p[0], p[1]) * orientation(*q, p[2], p[3]) <= 0)
        if across.any():
            return True
    return False


def intersects(a: Geometry, b: Geometry) -> bool:
    """Whether the two share a point; borders count."""
    if a.empty or b.empty:
        return False
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.bounds, b.bounds
    if ax0 > bx1 or bx0 > ax1 or ay0 > by1 or by0 > ay1:
        return False
    for one, other in ((a, b), (b, a)):
        vertices = one.vertices
        if any(in_polygon(vertices, rings).any() for rings in other.polygons):
            return True
        edges = other.segments()
        if len(one.points) and len(edges) and on_segments(one.points, edges).any():
            return True
    if len(a.points) and len(b.points) and (a.points[:, None] == b.points[None]).all(2).any():
        return True
    left, right = a.segments(), b.segments()
    return bool(len(left) and len(right)) and segments_meet(left, right)


def points_in(points: np.ndarray, region: Geometry) -> np.ndarray:
    """For each point, whether it lies in the region."""
    out = np.zeros(len(points), bool)
    x0, y0, x1, y1 = region.bounds
    near = (points[:, 0] >= x0) & (points[:, 0] <= x1) & (points[:, 1] >= y0) & (points[:, 1] <= y1)
    inside = points[near]
    hit = np.zeros(len(inside), bool)
    for rings in region.polygons:
        hit |= in_polygon(inside, rings)
    edges = region.segments()
    if len(edges) and region.lines:
        hit |= on_segments(inside, edges)
    if len(region.points):
        hit |= (inside[:, None] == region.points[None]).all(2).any(1)
    out[near] = hit
    return out


def intersecting(values: pd.Series, region: Geometry) -> np.ndarray:
    """For each WKB value, whether it intersects the region; null is False."""
    out = np.zeros(len(values), bool)
    given = values.to_numpy()
    simple = np.array([v is not None and len(v) == 21 and v[:5] == b"\x01\x01\x00\x00\x00" for v in given], bool)
    if simple.any():
        flat = np.frombuffer(b"".join(bytes(v[5:]) for v in given[simple]), "<f8").reshape(-1, 2)
        out[simple] = points_in(flat, region)
    for i in np.flatnonzero(~simple):
        if given[i] is not None:
            out[i] = intersects(Geometry.from_wkb(given[i]), region)
    return out


def st_intersects(geometry: Column, region: Geometry) -> Column:
    """Whether the WKB column intersects a constant region."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(intersecting(values, region))

    return run(geometry)
