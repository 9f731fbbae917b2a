"""Geometry values: points, lines and polygons as numpy arrays, with WKB, WKT and GeoJSON forms.

A `Geometry` is a bag of simple parts; a multi-geometry or a collection has
several.  Coordinates are x, y; Z and M are read and dropped.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
from dataclasses import dataclass
from typing import Any

import numpy as np

# WKB type codes.
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = 1, 2, 3, 4, 5, 6, 7
_NAMES = {"POINT": 1, "LINESTRING": 2, "LINEARRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6, "GEOMETRYCOLLECTION": 7}
_SINGLE = {MULTI_POINT: POINT, MULTI_LINE: LINE, MULTI_POLYGON: POLYGON}


@dataclass(frozen=True)
class Geometry:
    """points: (n, 2); lines: arrays (k, 2); polygons: tuples of closed rings, the exterior first."""

    points: np.ndarray
    lines: tuple[np.ndarray, ...] = ()
    polygons: tuple[tuple[np.ndarray, ...], ...] = ()

    @classmethod
    def box(cls, xmin: float, ymin: float, xmax: float, ymax: float) -> Geometry:
        return cls.polygon([(xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin), (xmax, ymin)])

    @classmethod
    def polygon(cls, exterior: Any, *holes: Any) -> Geometry:
        return cls(_NONE, (), (tuple(_closed(np.asarray(r, float).reshape(-1, 2)) for r in (exterior, *holes)),))

    @classmethod
    def point(cls, x: float, y: float) -> Geometry:
        return cls(np.array([[x, y]], float))

    @classmethod
    def line(cls, coordinates: Any) -> Geometry:
        return cls(_NONE, (np.asarray(coordinates, float).reshape(-1, 2),))

    @classmethod
    def union(cls, *parts: Geometry) -> Geometry:
        """All parts together; a region that several cover counts once in every predicate."""
        return cls(np.concatenate([_NONE, *(p.points for p in parts)]), sum((p.lines for p in parts), ()), sum((p.polygons for p in parts), ()))

    @property
    def empty(self) -> bool:
        return not (len(self.points) or self.lines or self.polygons)

    @property
    def vertices(self) -> np.ndarray:
        return np.concatenate([self.points, *self.lines, *(r for p in self.polygons for r in p)])

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        v = self.vertices
        if not len(v):
            return (math.nan,) * 4
        return (*v.min(0).tolist(), *v.max(0).tolist())

    @property
    def is_rectangle(self) -> bool:
        """Whether the region equals its bounds: one ring of that area whose vertices lie on their border."""
        if len(self.points) or self.lines or len(self.polygons) != 1 or len(self.polygons[0]) != 1:
            return False
        ring, (x0, y0, x1, y1) = self.polygons[0][0], self.bounds
        on_border = np.isin(ring[:, 0], (x0, x1)) | np.isin(ring[:, 1], (y0, y1))
        return bool(on_border.all()) and math.isclose(abs(_area(ring)), (x1 - x0) * (y1 - y0), rel_tol=1e-12) and _area(ring) != 0

    def segments(self) -> np.ndarray:
        """(n, 4): every edge of lines and rings as x0, y0, x1, y1."""
        runs = [*self.lines, *(r for p in self.polygons for r in p)]
        edges = [np.hstack([r[:-1], r[1:]]) for r in runs if len(r) > 1]
        return np.concatenate(edges) if edges else np.zeros((0, 4))

    # Forms.

    @classmethod
    def from_wkb(cls, data: bytes) -> Geometry:
        parts, end = _read_wkb(bytes(data), 0)
        return cls.union(*parts)

    def to_wkb(self) -> bytes:
        singles = [struct.pack("<BIdd", 1, POINT, *p) for p in self.points.tolist()]
        singles += [struct.pack("<BII", 1, LINE, len(x)) + x.astype("<f8").tobytes() for x in self.lines]
        singles += [struct.pack("<BII", 1, POLYGON, len(p)) + b"".join(struct.pack("<I", len(r)) + r.astype("<f8").tobytes() for r in p) for p in self.polygons]
        if len(singles) == 1:
            return singles[0]
        kinds = {int.from_bytes(s[1:5], "little") for s in singles}
        kind = kinds.pop() + 3 if len(kinds) == 1 else COLLECTION
        return struct.pack("<BII", 1, kind, len(singles)) + b"".join(singles)

    @classmethod
    def from_wkt(cls, text: str) -> Geometry:
        tokens = re.findall(r"[A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),]", re.sub(r"^\s*SRID=\d+;", "", text))
        if re.sub(r"[A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),\s]", "", re.sub(r"^\s*SRID=\d+;", "", text)):
            raise ValueError("not WKT")
        parts, rest = _read_wkt(tokens)
        if rest:
            raise ValueError("text behind the geometry")
        return cls.union(*parts)

    def to_wkt(self) -> str:
        pair = lambda p: f"{p[0]:.16g} {p[1]:.16g}"
        run = lambda r: "(" + ", ".join(map(pair, r.tolist())) + ")"
        singles = [("POINT", f"({pair(p)})") for p in self.points.tolist()] + [("LINESTRING", run(x)) for x in self.lines] + [("POLYGON", "(" + ", ".join(map(run, p)) + ")") for p in self.polygons]
        if len(singles) == 1:
            return " ".join(singles[0])
        if not singles:
            return "GEOMETRYCOLLECTION EMPTY"
        if len({kind for kind, _ in singles}) == 1:
            return f"MULTI{singles[0][0]} ({', '.join(body for _, body in singles)})"
        return f"GEOMETRYCOLLECTION ({', '.join(' '.join(s) for s in singles)})"

    @classmethod
    def from_geojson(cls, value: str | dict) -> Geometry:
        """A geometry, a Feature, or a FeatureCollection (the union of its features)."""
        given = json.loads(value) if isinstance(value, str) else value
        kind = given["type"]
        if kind == "Feature":
            return cls.from_geojson(given["geometry"])
        if kind in ("FeatureCollection", "GeometryCollection"):
            return cls.union(*(cls.from_geojson(g) for g in given["features" if kind == "FeatureCollection" else "geometries"]))
        if kind.upper() not in _NAMES:
            raise ValueError(f"unknown geometry type {kind}")
        code, at = _NAMES[kind.upper()], given["coordinates"]
        return cls.union(*_single(code, at)) if code in _SINGLE.values() else cls.union(*(p for x in at for p in _single(_SINGLE[code], x)))

    # Identity.

    def canonical(self) -> Geometry:
        """Rings counter-clockwise from their smallest vertex, 7 decimals, parts and holes by centroid: equal regions drawn alike compare equal."""
        turned = [(_turned(p[0]), *sorted((_turned(r) for r in p[1:]), key=_centroid)) for p in self.polygons]
        return Geometry(np.array(sorted(np.round(self.points, 7).tolist())).reshape(-1, 2), tuple(sorted((np.round(x, 7) for x in self.lines), key=_centroid)), tuple(sorted(turned, key=lambda p: _centroid(p[0]))))

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().to_wkt().encode()).hexdigest()[:8]


_NONE = np.zeros((0, 2))


def _closed(ring: np.ndarray) -> np.ndarray:
    return ring if len(ring) == 0 or (ring[0] == ring[-1]).all() else np.concatenate([ring, ring[:1]])


def _area(ring: np.ndarray) -> float:
    """Twice signed, halved: positive for counter-clockwise rings."""
    x, y = ring[:, 0], ring[:, 1]
    return 0.5 * float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())


def _centroid(ring: np.ndarray) -> tuple[float, float]:
    return tuple(ring[:-1].mean(0).tolist() if len(ring) > 1 else ring.mean(0).tolist())


def _turned(ring: np.ndarray) -> np.ndarray:
    own = (ring if _area(ring) >= 0 else ring[::-1])[:-1]
    first = min(range(len(own)), key=lambda i: tuple(own[i])) if len(own) else 0
    return np.round(_closed(np.roll(own, -first, axis=0)), 7)


def _single(code: int, at: Any) -> list[Geometry]:
    if not len(at):
        return []
    if code == POINT:
        return [Geometry.point(at[0], at[1])]
    if code == LINE:
        return [Geometry.line([c[:2] for c in at])]
    return [Geometry.polygon(*[[c[:2] for c in ring] for ring in at])]


def _read_wkb(data: bytes, at: int) -> tuple[list[Geometry], int]:
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    size = 2
    if code & 0xE0000000:  # the flags of extended WKB: Z, M, SRID
        size += bool(code & 0x80000000) + bool(code & 0x40000000)
        at += 4 * bool(code & 0x20000000)
        code &= 0x1FFFFFFF
    size += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    code %= 1000

    def run(at: int) -> tuple[np.ndarray, int]:
        (n,) = struct.unpack_from(order + "I", data, at)
        return np.frombuffer(data, order + "f8", n * size, at + 4).reshape(n, size)[:, :2].astype(float), at + 4 + 8 * n * size

    if code == POINT:
        xy = struct.unpack_from(order + "2d", data, at)
        return ([] if math.isnan(xy[0]) else [Geometry.point(*xy)]), at + 8 * size
    if code == LINE:
        xy, at = run(at)
        return ([Geometry(_NONE, (xy,))] if len(xy) else []), at
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if code == POLYGON:
        rings = []
        for _ in range(n):
            ring, at = run(at)
            rings.append(_closed(ring))
        return ([Geometry(_NONE, (), (tuple(rings),))] if rings and len(rings[0]) else []), at
    if code not in (MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION):
        raise ValueError(f"unknown WKB type {code}")
    parts: list[Geometry] = []
    for _ in range(n):
        more, at = _read_wkb(data, at)
        parts += more
    return parts, at


def _read_wkt(tokens: list[str]) -> tuple[list[Geometry], list[str]]:
    if not tokens or tokens[0].upper() not in _NAMES:
        raise ValueError("not WKT")
    code, rest = _NAMES[tokens[0].upper()], tokens[1:]
    while rest and rest[0].upper() in ("Z", "M", "ZM"):
        rest = rest[1:]
    if rest and rest[0].upper() == "EMPTY":
        return [], rest[1:]
    if code == COLLECTION:
        parts: list[Geometry] = []
        rest = _expect(rest, "(")
        while True:
            more, rest = _read_wkt(rest)
            parts += more
            if rest[:1] != [","]:
                return parts, _expect(rest, ")")
            rest = rest[1:]
    nested, rest = _nested(rest)
    if code == POINT:
        return _single(code, nested[0]), rest
    if code == MULTI_POINT:
        return [g for x in nested for g in _single(POINT, x[0] if isinstance(x[0], list) else x)], rest
    return (_single(code, nested) if code in (LINE, POLYGON) else [g for x in nested for g in _single(_SINGLE[code], x)]), rest


def _expect(tokens: list[str], what: str) -> list[str]:
    if tokens[:1] != [what]:
        raise ValueError(f"{what} expected")
    return tokens[1:]


def _nested(tokens: list[str]) -> tuple[list, list[str]]:
    """Lists of lists down to coordinates."""
    rest, out = _expect(tokens, "("), []
    while True:
        if rest[:1] == ["("]:
            item, rest = _nested(rest)
        else:
            item = []
            while rest and rest[0] not in "(),":
                item.append(float(rest[0]))
                rest = rest[1:]
            if len(item) < 2:
                raise ValueError("two numbers expected")
        out.append(item)
        if rest[:1] != [","]:
            return out, _expect(rest, ")")
        rest = rest[1:]
