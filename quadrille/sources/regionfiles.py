"""Regions from binary files: GeoPackage, Shapefile and FlatGeobuf, by their public formats, each to the parts that it holds.

A file is told by its first bytes, not by its name.  Coordinates are taken as
degrees of longitude and latitude; a file that says that it is in a projected
system is refused.  Heights and measures are skipped, as are empty and null
geometries and all attributes.
"""

from __future__ import annotations

import math
import sqlite3
import struct
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

import numpy as np

from quadrille.functions.geometry import Geometry

#: How the formats begin.
GEOPACKAGE, SHAPEFILE, FLATGEOBUF = b"SQLite format 3\x00", struct.pack(">i", 9994), b"fgb\x03fgb"


def parts(path: str) -> list[Geometry] | None:
    """The features' geometries, or None if the file is of none of these formats."""
    with open(path, "rb") as f:
        start = f.read(16)
    if start == GEOPACKAGE:
        return list(geopackage(path))
    if start.startswith(SHAPEFILE):
        return list(shapefile(path))
    if start.startswith(FLATGEOBUF):
        return list(flatgeobuf(Path(path).read_bytes()))
    return None


def _unprojected(definition: str) -> None:
    if definition.lstrip().upper().startswith(("PROJCS", "PROJCRS")):
        raise ValueError("the file's coordinates are projected, not longitude and latitude")


# GeoPackage: tables of an SQLite file, listed in a table; a geometry is WKB behind a header.


def geopackage(path: str) -> Iterator[Geometry]:
    """Of the first feature table that the file lists."""
    with closing(sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True)) as db:
        found = db.execute(
            "SELECT c.table_name, c.column_name, c.srs_id FROM gpkg_geometry_columns c JOIN gpkg_contents t ON t.table_name = c.table_name "
            "WHERE t.data_type = 'features' ORDER BY t.rowid LIMIT 1"
        ).fetchone()
        if not found:
            raise ValueError("the file lists no features")
        table, column, system = found
        for (definition,) in db.execute("SELECT definition FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (system,)):
            _unprojected(definition)
        name, geometry = ('"' + x.replace('"', '""') + '"' for x in (table, column))
        for (blob,) in db.execute(f"SELECT {geometry} FROM {name} WHERE {geometry} IS NOT NULL"):
            yield Geometry.from_wkb(_behind_header(blob))


def _behind_header(blob: bytes) -> bytes:
    """A header is GP, version, flags, the system's number and a box of 0, 4, 6 or 8 numbers, as bits 1 to 3 of the flags say."""
    if blob[:2] != b"GP":
        raise ValueError("no GeoPackage geometry")
    return blob[8 + 8 * (0, 4, 6, 6, 8)[blob[3] >> 1 & 7] :]


# Shapefile: records of one kind; a polygon's rings stand in any order, outer ones clockwise.

_POINT, _LINE, _POLYGON, _POINTS = 1, 3, 5, 8


def shapefile(path: str) -> Iterator[Geometry]:
    """Of the .shp file alone; a .prj file beside it is looked at."""
    system = next((p for p in (Path(path).with_suffix(s) for s in (".prj", ".PRJ")) if p.exists()), None)
    if system:
        _unprojected(system.read_text(errors="replace"))
    data, at = Path(path).read_bytes(), 100
    while at + 12 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        if words < 2 or at + 8 + 2 * words > len(data):
            raise ValueError("a record reaches beyond the file")
        yield from _record(data[at + 8 : at + 8 + 2 * words])
        at += 8 + 2 * words


def _record(body: bytes) -> Iterator[Geometry]:
    (code,) = struct.unpack_from("<i", body)
    kind = code % 10  # with heights 10 is added, with measures 20
    if code == 0:
        return
    if kind == _POINT:
        yield Geometry.point(*struct.unpack_from("<2d", body, 4))
    elif kind == _POINTS:
        (n,) = struct.unpack_from("<i", body, 36)
        yield Geometry(np.frombuffer(body, "<f8", 2 * n, 40).reshape(n, 2).astype(float))
    elif kind in (_LINE, _POLYGON):
        n, m = struct.unpack_from("<2i", body, 36)
        begins = np.frombuffer(body, "<i4", n, 44)
        xy = np.frombuffer(body, "<f8", 2 * m, 44 + 4 * n).reshape(m, 2).astype(float)
        runs = [r for r in np.split(xy, begins[1:]) if len(r)]
        if kind == _LINE:
            yield from map(Geometry.line, runs)
        else:
            yield from nested(runs)
    else:
        raise ValueError(f"no geometry of kind {code}")


def nested(rings: list[np.ndarray]) -> Iterator[Geometry]:
    """Polygons of clockwise rings, each with the counter-clockwise ones for which it is the smallest around them."""
    sizes = [float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum()) for r in rings]
    outer = sorted((i for i, s in enumerate(sizes) if s < 0), key=lambda i: -sizes[i])
    holes: dict[int, list[np.ndarray]] = {i: [] for i in outer}
    for i, s in enumerate(sizes):
        if s > 0:
            around = next((o for o in outer if -sizes[o] >= s and _inside(rings[i], rings[o])), None)
            if around is None:  # a ring turned the wrong way
                holes[i] = []
            else:
                holes[around].append(rings[i])
    for i, own in holes.items():
        yield Geometry.polygon(rings[i], *own)


def _inside(ring: np.ndarray, outer: np.ndarray) -> bool:
    """Whether a ring that doesn't cross the outer one lies in it: its first corner off the outer ring's corners does."""
    corners = set(map(tuple, outer.tolist()))
    x, y = next((p for p in map(tuple, ring.tolist()) if p not in corners), tuple(ring.mean(0)))
    a, b = outer, np.roll(outer, -1, 0)
    over = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[over], b[over]
    return bool(((a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])) > x).sum() % 2)


# FlatGeobuf: a header, a packed tree of boxes that a reader of everything skips, and features, as flat buffers.


class _Table:
    """A flat buffer's table: its fields stand where the table's index of fields says, if at all."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.index = at - struct.unpack_from("<i", data, at)[0]
        self.fields = (struct.unpack_from("<H", data, self.index)[0] - 4) // 2

    @classmethod
    def root(cls, data: bytes) -> _Table:
        return cls(data, struct.unpack_from("<I", data)[0])

    def _place(self, field: int) -> int:
        move = struct.unpack_from("<H", self.data, self.index + 4 + 2 * field)[0] if field < self.fields else 0
        return self.at + move if move else 0

    def _target(self, place: int) -> int:
        return place + struct.unpack_from("<I", self.data, place)[0]

    def number(self, field: int, kind: str, missing: int) -> int:
        place = self._place(field)
        return struct.unpack_from("<" + kind, self.data, place)[0] if place else missing

    def numbers(self, field: int, kind: str) -> np.ndarray:
        place = self._place(field)
        if not place:
            return np.zeros(0, kind)
        at = self._target(place)
        return np.frombuffer(self.data, kind, struct.unpack_from("<I", self.data, at)[0], at + 4)

    def table(self, field: int) -> _Table | None:
        place = self._place(field)
        return _Table(self.data, self._target(place)) if place else None

    def tables(self, field: int) -> list[_Table]:
        place = self._place(field)
        if not place:
            return []
        at = self._target(place)
        (n,) = struct.unpack_from("<I", self.data, at)
        return [_Table(self.data, self._target(at + 4 + 4 * i)) for i in range(n)]

    def text(self, field: int) -> str:
        return self.numbers(field, "u1").tobytes().decode(errors="replace")


#: Numbers of the format's fields.
_HEADER_KIND, _HEADER_COUNT, _HEADER_NODE, _HEADER_SYSTEM, _SYSTEM_WKT = 2, 8, 9, 10, 4
_ENDS, _XY, _KIND, _PARTS = 0, 1, 6, 7
#: Bytes of a box in the tree.
_NODE_BYTES = 40


def tree_bytes(features: int, node: int) -> int:
    """Of a packed tree: a box for each feature, and for each `node` boxes one above, up to one."""
    if not features or not node:
        return 0
    total = level = features
    while level > 1:
        level = math.ceil(level / node)
        total += level
    return (total + (features == 1)) * _NODE_BYTES


def flatgeobuf(data: bytes) -> Iterator[Geometry]:
    (size,) = struct.unpack_from("<I", data, 8)
    header = _Table.root(data[12 : 12 + size])
    system = header.table(_HEADER_SYSTEM)
    if system:
        _unprojected(system.text(_SYSTEM_WKT))
    at = 12 + size + tree_bytes(header.number(_HEADER_COUNT, "Q", 0), header.number(_HEADER_NODE, "H", 16))
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<I", data, at)
        if at + 4 + size > len(data):
            raise ValueError("a feature reaches beyond the file")
        geometry = _Table.root(data[at + 4 : at + 4 + size]).table(0)
        if geometry:
            yield from _shape(geometry, header.number(_HEADER_KIND, "B", 0))
        at += 4 + size


def _shape(held: _Table, kind: int) -> Iterator[Geometry]:
    """Kinds are numbered as in WKB; 0 in the header leaves it to the geometry."""
    kind = held.number(_KIND, "B", 0) or kind
    xy = held.numbers(_XY, "<f8").reshape(-1, 2).astype(float)
    runs = [r for r in np.split(xy, held.numbers(_ENDS, "<u4")[:-1].astype(int)) if len(r)]
    if kind in (1, 4):
        yield Geometry(xy)
    elif kind in (2, 5):
        yield from map(Geometry.line, runs)
    elif kind == 3:
        if runs:
            yield Geometry.polygon(*runs)
    elif kind in (6, 7):
        for part in held.tables(_PARTS):
            yield from _shape(part, 3 if kind == 6 else 0)
    else:
        raise ValueError(f"no geometry of kind {kind}")
