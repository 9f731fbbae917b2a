"""Regions from grid cells: geohash and S2 cells."""

from __future__ import annotations

import math

from quadrille.functions.geometry import Geometry
from quadrille.functions.overlay import union

#: The geohash alphabet.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_bounds(code: str) -> tuple[float, float, float, float]:
    """(xmin, ymin, xmax, ymax): the code's bits, longitude first, number the cell in a 2**a by 2**b grid."""
    text = code.lower()
    if not text or any(c not in GEOHASH for c in text):
        raise ValueError("Invalid geohash")
    bits = "".join(f"{GEOHASH.index(c):05b}" for c in text)
    lon, lat = bits[0::2], bits[1::2]
    width, height = 360 / 2 ** len(lon), 180 / 2 ** len(lat)
    x, y = int(lon, 2), int(lat, 2)
    return x * width - 180, y * height - 90, (x + 1) * width - 180, (y + 1) * height - 90


def geohash_region(codes: str) -> Geometry:
    """The union of comma-separated geohash cells."""
    return union(Geometry.box(*geohash_bounds(c.strip())) for c in codes.split(","))


#: Order of the four children along the curve as (i, j), and how the orientation changes, by orientation (bit 0: swapped, bit 1: inverted).
_IJ = (((0, 0), (0, 1), (1, 1), (1, 0)), ((0, 0), (1, 0), (1, 1), (0, 1)), ((1, 1), (1, 0), (0, 0), (0, 1)), ((1, 1), (0, 1), (0, 0), (1, 0)))
_TURN = (1, 0, 0, 3)


def s2_cell(token: str) -> Geometry:
    """The quadrilateral of a cell's four corners: token to face and curve position to (i, j) to the cube face."""
    text = token.strip().lower()
    if not text or len(text) > 16 or any(c not in "0123456789abcdef" for c in text):
        raise ValueError(f"Invalid S2 token {token}")
    cell = int(text.ljust(16, "0"), 16)
    face = cell >> 61
    low = cell & -cell
    if face > 5 or not cell or low.bit_length() % 2 == 0:
        raise ValueError(f"Invalid S2 token {token}")
    level = 30 - (low.bit_length() - 1) // 2
    i = j = 0
    turn = face & 1
    for k in range(level):
        at = (cell >> (59 - 2 * k)) & 3
        di, dj = _IJ[turn][at]
        i, j, turn = 2 * i + di, 2 * j + dj, turn ^ _TURN[at]
    n = 1 << level
    corners = [_lonlat(face, _uv((i + a) / n), _uv((j + b) / n)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    return Geometry.polygon(corners)


def _uv(s: float) -> float:
    """S2's quadratic projection of a cell-space coordinate."""
    return (4 * s * s - 1) / 3 if s >= 0.5 else (1 - 4 * (1 - s) * (1 - s)) / 3


def _lonlat(face: int, u: float, v: float) -> tuple[float, float]:
    x, y, z = ((1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1))[face]
    return math.degrees(math.atan2(y, x)), math.degrees(math.atan2(z, math.hypot(x, y)))


def s2_region(tokens: str) -> Geometry:
    """The union of comma-separated S2 cells."""
    return union(s2_cell(t) for t in tokens.split(","))
