"""A region as a grid of cells inside, outside and on its border, so that most rows need no exact test.

A cell that no edge touches is wholly inside or wholly outside.  A feature whose
box lies in one such cell is decided by native expressions; the rest goes to the
exact test, which looks at the edges of its own band of cells only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.geometry import Geometry
from quadrille.functions.intersects import _beside, in_polygon, intersects, on_segments, segments_meet

OUTSIDE, INSIDE, BORDER = 0, 1, 2
#: Cells of a side at most, and the share of border cells at which the grid is fine enough.
SIDE, ENOUGH = 512, 0.02
#: What single-precision boxes may be off, in parts of the largest coordinate.
FLOAT_BOX = 2.0**-23
_CELLS = 1 << 22


@dataclass(frozen=True, eq=False)
class Covering:
    """`kinds`: (rows, columns) of OUTSIDE, INSIDE, BORDER over the region's bounds."""

    region: Geometry
    kinds: np.ndarray
    x0: float
    y0: float
    width: float
    height: float
    _bands: Bands = field(repr=False)

    def kind(self, bbox: str = "bbox") -> Column:
        """OUTSIDE or INSIDE if the row's box lies in one cell of that kind, else BORDER."""
        n_rows, n_columns = self.kinds.shape
        at = {k: F.floor((F.col(f"{bbox}.{k}") - low) / size) for k, low, size in (("xmin", self.x0, self.width), ("xmax", self.x0, self.width), ("ymin", self.y0, self.height), ("ymax", self.y0, self.height))}
        one_cell = (at["xmin"] == at["xmax"]) & (at["ymin"] == at["ymax"]) & at["xmin"].between(0, n_columns - 1) & at["ymin"].between(0, n_rows - 1)
        text = ",".join("".join(map(str, row)) for row in self.kinds.tolist())
        row = F.element_at(F.split(F.lit(text), ","), (at["ymin"] + 1).cast("int"))
        return F.when(one_cell, F.substr(row, (at["xmin"] + 1).cast("int"), F.lit(1)).cast("int")).otherwise(BORDER)

    def points_in(self, points: np.ndarray) -> np.ndarray:
        """For each point, whether it lies in the region, by the edges of its band."""
        return self._bands.points_in(points, self.region)

    def intersects(self, other: Geometry) -> bool:
        """Whether a geometry and the region share a point; of the region, edges near the geometry are looked at."""
        if other.empty or self.region.empty:
            return False
        ax0, ay0, ax1, ay1 = other.bounds
        edges = self._bands.near(ax0, ay0, ax1, ay1)
        if self.points_in(other.vertices).any():
            return True
        points = self.region.points
        inside = np.concatenate([edges[:, :2], points])
        if len(inside) and any(in_polygon(inside, rings).any() for rings in other.polygons):
            return True
        own = other.segments()
        if len(own) and len(points) and on_segments(points, own).any():
            return True
        return bool(len(own) and len(edges)) and segments_meet(own, edges)


@dataclass(frozen=True, eq=False)
class Bands:
    """The region's edges by rows of cells: those of row r are `order[start[r]:start[r + 1]]`."""

    edges: np.ndarray
    part: np.ndarray
    order: np.ndarray
    start: np.ndarray
    y0: float
    height: float

    def _row(self, y: np.ndarray | float) -> np.ndarray:
        return np.clip(np.floor((np.asarray(y, float) - self.y0) / self.height), 0, len(self.start) - 2).astype(np.int64)

    def near(self, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
        """Edges whose box touches the given one."""
        first, last = self._row([y0, y1])
        own = self.edges[np.unique(self.order[self.start[first] : self.start[last + 1]])]
        touching = (np.minimum(own[:, 0], own[:, 2]) <= x1) & (np.maximum(own[:, 0], own[:, 2]) >= x0) & (np.minimum(own[:, 1], own[:, 3]) <= y1) & (np.maximum(own[:, 1], own[:, 3]) >= y0)
        return own[touching]

    def points_in(self, points: np.ndarray, region: Geometry) -> np.ndarray:
        out = np.zeros(len(points), bool)
        x0, y0, x1, y1 = region.bounds
        near = np.flatnonzero((points[:, 0] >= x0) & (points[:, 0] <= x1) & (points[:, 1] >= y0) & (points[:, 1] <= y1))
        rows = self._row(points[near, 1])
        by_row = np.argsort(rows, kind="stable")
        for own in np.split(by_row, np.flatnonzero(np.diff(rows[by_row])) + 1):
            if not len(own):
                continue
            r = rows[own[0]]
            at = self.order[self.start[r] : self.start[r + 1]]
            if len(at):
                out[near[own]] = self._hit(points[near[own]], self.edges[at], self.part[at])
        if len(region.points):
            out[near] |= (points[near][:, None] == region.points[None]).all(2).any(1)
        return out

    @staticmethod
    def _hit(points: np.ndarray, edges: np.ndarray, part: np.ndarray) -> np.ndarray:
        """In any polygon by parity, or on an edge; edges are in order of their polygon, those of lines (-1) first."""
        out = np.zeros(len(points), bool)
        starts = np.flatnonzero(np.r_[True, np.diff(part) != 0])
        solid = part[starts] >= 0
        step = max(1, _CELLS // len(edges))
        for i in range(0, len(points), step):
            passes, holds = _beside(points[i : i + step], edges)
            odd = np.add.reduceat(passes, starts, axis=1, dtype=np.int64) % 2 == 1
            out[i : i + step] = odd[:, solid].any(1) | holds.any(1)
        return out


def _pieces(edges: np.ndarray, width: float, height: float) -> np.ndarray:
    """The edges cut in halves until none is longer than a cell either way."""
    while True:
        long = (np.abs(edges[:, 0] - edges[:, 2]) > width) | (np.abs(edges[:, 1] - edges[:, 3]) > height)
        if not long.any():
            return edges
        cut = edges[long]
        middle = (cut[:, :2] + cut[:, 2:]) / 2
        edges = np.concatenate([edges[~long], np.hstack([cut[:, :2], middle]), np.hstack([middle, cut[:, 2:]])])


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, number) for all numbers from first to last of each item."""
    n = np.maximum(last - first + 1, 0)
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + first[item]


def _kinds(region: Geometry, n: int, margin: float) -> tuple[np.ndarray, float, float]:
    x0, y0, x1, y1 = region.bounds
    width, height = max((x1 - x0) / n, margin, 1e-12), max((y1 - y0) / n, margin, 1e-12)
    column = lambda x: np.clip(np.floor((x - x0) / width), 0, n - 1).astype(np.int64)
    row = lambda y: np.clip(np.floor((y - y0) / height), 0, n - 1).astype(np.int64)
    kinds = np.zeros((n, n), np.int8)
    for rings in region.polygons:
        edges = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
        low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
        # Middles of rows that an edge passes, and there the first column whose middle lies behind it.
        item, r = _spans(np.maximum(np.ceil((low - y0) / height - 0.5), 0).astype(np.int64), np.minimum(np.ceil((high - y0) / height - 0.5).astype(np.int64) - 1, n - 1))
        e, y = edges[item], y0 + (r + 0.5) * height
        x = e[:, 0] + (e[:, 2] - e[:, 0]) * ((y - e[:, 1]) / np.where(e[:, 3] == e[:, 1], 1, e[:, 3] - e[:, 1]))
        turns = np.zeros((n, n + 1), np.int64)
        np.add.at(turns, (r, np.clip(np.ceil((x - x0) / width - 0.5), 0, n).astype(np.int64)), 1)
        kinds |= (turns.cumsum(1)[:, :n] % 2).astype(np.int8)
    around = max(margin, 1e-6 * max(width, height), 4e-16 * max(map(abs, (x0, y0, x1, y1))))
    touched = np.concatenate([_pieces(region.segments(), width, height), np.hstack([region.points, region.points])])
    least, most = np.minimum(touched[:, :2], touched[:, 2:]) - around, np.maximum(touched[:, :2], touched[:, 2:]) + around
    item, r = _spans(row(least[:, 1]), row(most[:, 1]))
    again, c = _spans(column(least[item, 0]), column(most[item, 0]))
    kinds[r[again], c] = BORDER
    return kinds, width, height


def covering(region: Geometry, float_boxes: bool = False) -> Covering:
    """Finer until few cells are border; `float_boxes`: the rows' boxes are rounded to single precision."""
    x0, y0, x1, y1 = region.bounds
    margin = FLOAT_BOX * max(map(abs, (x0, y0, x1, y1))) if float_boxes else 0.0
    n = 16
    while True:
        kinds, width, height = _kinds(region, n, margin)
        if n >= SIDE or (kinds == BORDER).mean() <= ENOUGH:
            break
        n *= 2
    runs = [(-1, x) for x in region.lines if len(x) > 1] + [(i, r) for i, p in enumerate(region.polygons) for r in p]
    edges = np.concatenate([np.zeros((0, 4)), *(np.hstack([r[:-1], r[1:]]) for _, r in runs)])
    part = np.concatenate([np.zeros(0, np.int64), *(np.full(len(r) - 1, i) for i, r in runs)])
    index = lambda y: np.clip(np.floor((y - y0) / height), 0, n - 1).astype(np.int64)
    item, r = _spans(index(np.minimum(edges[:, 1], edges[:, 3])), index(np.maximum(edges[:, 1], edges[:, 3])))
    by_row = np.argsort(r, kind="stable")
    bands = Bands(edges, part, item[by_row], np.searchsorted(r[by_row], np.arange(n + 1)), y0, height)
    return Covering(region, kinds, x0, y0, width, height, bands)


def intersecting(values: pd.Series, cover: Covering) -> np.ndarray:
    """For each WKB value, whether it intersects the region; null is False."""
    out = np.zeros(len(values), bool)
    given = values.to_numpy()
    simple = np.array([v is not None and len(v) == 21 and v[:5] == b"\x01\x01\x00\x00\x00" for v in given], bool)
    if simple.any():
        out[simple] = cover.points_in(np.frombuffer(b"".join(bytes(v[5:]) for v in given[simple]), "<f8").reshape(-1, 2))
    for i in np.flatnonzero(~simple):
        if given[i] is not None:
            other = Geometry.from_wkb(given[i])
            out[i] = cover.intersects(other) if len(cover.region.vertices) > 64 else intersects(other, cover.region)
    return out


def covered_intersects(geometry: Column, cover: Covering) -> Column:
    """The exact test of a WKB column by the covering's bands."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(intersecting(values, cover))

    return run(geometry)
