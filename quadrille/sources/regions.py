"""Regions from text and files, as command lines and callers give them."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import struct
from pathlib import Path

from quadrille.errors import BadParameter
from quadrille.functions.cells import geohash_region, s2_region
from quadrille.functions.geometry import Geometry
from quadrille.functions.hexagons import h3_region
from quadrille.functions.overlay import dissolved, union
from quadrille.sources import regionfiles


def from_bbox(text: str) -> Geometry:
    """xmin,ymin,xmax,ymax."""
    try:
        values = [float(x.strip()) for x in text.split(",")]
    except ValueError:
        values = []
    if len(values) != 4:
        raise BadParameter("Cannot parse the bounding box: four numbers with commas between are expected")
    return Geometry.box(*values)


def _or_bad(what: str, make, text: str) -> Geometry:
    try:
        return make(text)
    except NotImplementedError:
        raise
    except Exception as e:
        raise BadParameter(f"Cannot parse {what}: {text}") from e


def from_wkt(text: str) -> Geometry:
    return _or_bad("WKT", Geometry.from_wkt, text)


def from_geojson(text: str) -> Geometry:
    return _or_bad("GeoJSON", Geometry.from_geojson, text)


def from_geohash(text: str) -> Geometry:
    return _or_bad("geohash", geohash_region, text)


def from_s2(text: str) -> Geometry:
    return _or_bad("S2 token", s2_region, text)


def from_h3(text: str) -> Geometry:
    return _or_bad("H3 cell", h3_region, text)


def from_file(path: str) -> Geometry:
    """A GeoJSON, WKT, GeoPackage, Shapefile or FlatGeobuf file; several features or WKT lines are one region, without borders between them."""
    try:
        parts = regionfiles.parts(path)
        if parts is not None:
            return union(parts)
        text = Path(path).read_text()
    except OSError as e:
        raise BadParameter(f"Cannot read {path}") from e
    except (ValueError, struct.error, sqlite3.Error) as e:
        raise BadParameter(f"Cannot parse {path}: {e}") from e
    if text.lstrip().startswith("{"):
        return dissolved(from_geojson(text))
    return union(from_wkt(line) for line in text.splitlines() if line.strip())


def geocode(query: str, cache: str = "geocoding_cache") -> Geometry:
    """A region that an earlier geocoding left in the cache folder as GeoJSON; the service itself needs a network."""
    path = Path(cache) / f"{hashlib.sha256(query.encode()).hexdigest()[:16]}.json"
    if not path.exists():
        raise NotImplementedError(f"geocoding needs a network; put the region of {query!r} as GeoJSON into {path}")
    return Geometry.from_geojson(json.loads(path.read_text()))
