"""Region files against the GeoJSON form of the same features; the files are written here, by the formats' definitions."""

import json
import sqlite3
import struct

import pytest

from quadrille.errors import BadParameter
from quadrille.functions.geometry import Geometry
from quadrille.sources import regionfiles, regions

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]
ISLAND = [[2.5, 2.5], [3.5, 2.5], [3.5, 3.5], [2.5, 3.5], [2.5, 2.5]]
FAR = [[20, 20], [30, 20], [25, 28.5], [20, 20]]
NEXT = [[10, 0], [20, 0], [20, 10], [10, 10], [10, 0]]
FEATURES = [
    {"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE], [ISLAND], [FAR]]},
    {"type": "Polygon", "coordinates": [NEXT]},
]


@pytest.fixture
def wanted(tmp_path):
    path = tmp_path / "r.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": g} for g in FEATURES]}))
    region = regions.from_file(str(path))
    assert len(region.polygons) == 3 and region.bounds == (0, 0, 30, 28.5)  # the two neighbours are one
    return region.digest()


def geopackage(path, blobs, definition='GEOGCS["WGS 84"]'):
    db = sqlite3.connect(path)
    db.executescript('''CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER, definition TEXT);
        CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER);
        CREATE TABLE "the ""places" (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT);
        INSERT INTO gpkg_contents VALUES ('other', 'attributes'), ('the "places', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('the "places', 'geom', 4326);''')
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('x', 4326, ?)", (definition,))
    db.executemany('INSERT INTO "the ""places" (geom) VALUES (?)', [(b,) for b in blobs])
    db.commit()
    db.close()


def test_geopackage(tmp_path, wanted):
    path = str(tmp_path / "r.gpkg")
    shapes = [Geometry.from_geojson(g).to_wkb() for g in FEATURES]
    blobs = [b"GP\x00\x01" + struct.pack("<i", 4326) + shapes[0], b"GP\x00\x03" + struct.pack("<i4d", 4326, 0, 1, 0, 1) + shapes[1], None]
    geopackage(path, blobs)
    assert regions.from_file(path).digest() == wanted
    for name, kept, system in (("p.gpkg", blobs, ' PROJCS["UTM"]'), ("q.gpkg", [b"no geometry"], "")):
        geopackage(str(tmp_path / name), kept, system)
        with pytest.raises(BadParameter):
            regions.from_file(str(tmp_path / name))


def shapefile(path, bodies, kind=5):
    records = b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))
    head = struct.pack(">i20xi", 9994, (100 + len(records)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    path.write_bytes(head + records)


def shape(kind, rings):
    begins = [sum(map(len, rings[:i])) for i in range(len(rings))]
    points = [v for r in rings for p in r for v in p]
    return struct.pack(f"<i4d2i{len(rings)}i{len(points)}d", kind, *[0.0] * 4, len(rings), len(points) // 2, *begins, *points)


def test_shapefile(tmp_path, wanted):
    path = tmp_path / "r.shp"
    # Outer rings clockwise, holes the other way, in no order; HOLE above is drawn clockwise.
    shapefile(path, [shape(5, [HOLE[::-1], ISLAND[::-1], FAR[::-1], SQUARE[::-1]]), struct.pack("<i", 0), shape(15, [NEXT[::-1]])])
    assert regions.from_file(str(path)).digest() == wanted
    shapefile(path, [shape(5, [HOLE[::-1], FAR[::-1]])])  # a hole of nothing
    assert len(regions.from_file(str(path)).polygons) == 2
    (tmp_path / "r.prj").write_text('PROJCS["x"]')
    with pytest.raises(BadParameter):
        regions.from_file(str(path))
    (tmp_path / "r.prj").write_text('GEOGCS["x"]')
    shapefile(path, [struct.pack("<i2d", 1, 3.0, 4.0), struct.pack("<i4di4d", 8, *[0.0] * 4, 2, 1.0, 2.0, 5.0, 6.0), shape(3, [[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 2]]])])
    got = regions.from_file(str(path))
    assert got.points.tolist() == [[3, 4], [1, 2], [5, 6]] and [len(x) for x in got.lines] == [2, 3]
    path.write_bytes(path.read_bytes()[:-8])
    with pytest.raises(BadParameter):
        regions.from_file(str(path))


def flatgeobuf(features, count, node, kind=6, wkt=None):
    """`features`: lists of polygons; count 0 is a file that doesn't know its number of features."""
    import flatbuffers

    def finished(b, table):
        b.FinishSizePrefixed(table)
        return bytes(b.Output())

    def numbers(b, size, add, values):
        b.StartVector(size, len(values), size)
        for v in reversed(values):
            add(v)
        return b.EndVector()

    def polygon(b, rings):
        ends = numbers(b, 4, b.PrependUint32, [sum(map(len, rings[: i + 1])) for i in range(len(rings))]) if len(rings) > 1 else None
        xy = numbers(b, 8, b.PrependFloat64, [float(v) for r in rings for p in r for v in p])
        b.StartObject(8)
        if ends:
            b.PrependUOffsetTRelativeSlot(0, ends, 0)
        b.PrependUOffsetTRelativeSlot(1, xy, 0)
        return b.EndObject()

    b = flatbuffers.Builder()
    system = None
    if wkt:
        text = b.CreateString(wkt)
        b.StartObject(6)
        b.PrependUOffsetTRelativeSlot(4, text, 0)
        system = b.EndObject()
    b.StartObject(14)
    b.PrependUint8Slot(2, kind, 0)
    b.PrependUint64Slot(8, count, 0)
    b.PrependUint16Slot(9, node, 16)
    if system:
        b.PrependUOffsetTRelativeSlot(10, system, 0)
    out = b"fgb\x03fgb\x01" + finished(b, b.EndObject())
    boxes, level = 0, count if node else 0
    while level:
        boxes += level
        level = 0 if level == 1 and boxes > 1 else -(-level // node)
    out += b"\xff" * 40 * boxes
    for polygons in features:
        b = flatbuffers.Builder()
        held = [polygon(b, p) for p in polygons]
        parts = numbers(b, 4, b.PrependUOffsetTRelative, held)
        b.StartObject(8)
        b.PrependUint8Slot(6, 6, 0)
        b.PrependUOffsetTRelativeSlot(7, parts, 0)
        shape = b.EndObject()
        b.StartObject(3)
        b.PrependUOffsetTRelativeSlot(0, shape, 0)
        out += finished(b, b.EndObject())
    return out


def test_flatgeobuf(tmp_path, wanted):
    pytest.importorskip("flatbuffers")
    path, features = tmp_path / "r.fgb", [[[SQUARE, HOLE], [ISLAND], [FAR]], [[NEXT]]]
    for count, node, kind in ((2, 16, 6), (0, 16, 0), (2, 0, 0), (2, 2, 6)):
        path.write_bytes(flatgeobuf(features, count, node, kind))
        assert regions.from_file(str(path)).digest() == wanted
    many = [[[[[40 + 2 * k, 0], [41 + 2 * k, 0], [41 + 2 * k, 1], [40 + 2 * k, 0]]]] for k in range(40)]
    path.write_bytes(flatgeobuf(many, 40, 3))
    assert len(regions.from_file(str(path)).polygons) == 40
    assert regionfiles.tree_bytes(40, 3) == 40 * (40 + 14 + 5 + 2 + 1)
    for bad in (flatgeobuf(features, 2, 16, wkt='PROJCS["x"]'), flatgeobuf(features, 2, 16)[:-9]):
        path.write_bytes(bad)
        with pytest.raises(BadParameter):
            regions.from_file(str(path))
