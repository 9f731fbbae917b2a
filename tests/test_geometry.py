import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.functions.cells import geohash_bounds, geohash_region, s2_cell
from quadrille.functions.geometry import Geometry
from quadrille.functions.hilbert import curve_position
from quadrille.functions.intersects import intersects, points_in

whole = st.integers(-6, 6)
point = st.tuples(whole, whole)
box = st.tuples(whole, whole, st.integers(1, 5), st.integers(1, 5)).map(lambda b: Geometry.box(b[0], b[1], b[0] + b[2], b[1] + b[3]))
line = st.lists(point, min_size=2, max_size=5).map(Geometry.line)
shape = st.one_of(point.map(lambda p: Geometry.point(*p)), line, box, st.tuples(box, line).map(lambda x: Geometry.union(*x)))


@given(shape)
def test_wkb_and_wkt_round_trip(g):
    for other in (Geometry.from_wkb(g.to_wkb()), Geometry.from_wkt(g.to_wkt())):
        assert other.to_wkt() == g.to_wkt() and other.bounds == g.bounds


@given(shape, shape)
@settings(max_examples=200)
def test_intersects_is_symmetric_and_within_boxes(a, b):
    assert intersects(a, b) == intersects(b, a)
    if intersects(a, b):
        (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.bounds, b.bounds
        assert ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1


@given(box, st.lists(point, min_size=1, max_size=20))
def test_boxes_hold_the_points_between_their_bounds(g, ps):
    x0, y0, x1, y1 = g.bounds
    assert points_in(np.array(ps, float), g).tolist() == [x0 <= x <= x1 and y0 <= y <= y1 for x, y in ps]


def test_holes_are_open_and_their_borders_closed():
    ring = Geometry.polygon([(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)])
    assert points_in(np.array([[5, 5], [3, 5], [1, 1], [10, 10], [11, 1.0]]), ring).tolist() == [False, True, True, True, False]
    assert not intersects(ring, Geometry.box(4, 4, 6, 6))
    assert intersects(ring, Geometry.box(4, 4, 7, 6))
    assert intersects(Geometry.box(-5, -5, 20, 20), ring)


def test_wkb_variants():
    z = struct.pack("<BIddd", 1, 1001, 1, 2, 9)
    ewkb = struct.pack(">BIIdd", 0, 0x20000001, 4326, 1, 2)
    assert Geometry.from_wkb(z).bounds == Geometry.from_wkb(ewkb).bounds == (1, 2, 1, 2)
    many = struct.pack("<BII", 1, 7, 2) + Geometry.point(0, 0).to_wkb() + Geometry.box(1, 1, 2, 2).to_wkb()
    assert Geometry.from_wkb(many).bounds == (0, 0, 2, 2)
    assert Geometry.from_wkb(struct.pack("<BIdd", 1, 1, float("nan"), float("nan"))).empty
    with pytest.raises(ValueError):
        Geometry.from_wkb(struct.pack("<BII", 1, 17, 0))


def test_wkt_forms_and_errors():
    assert Geometry.from_wkt("SRID=4326;POINT Z (1 2 3)").bounds == (1, 2, 1, 2)
    assert Geometry.from_wkt("MULTIPOINT ((1 2), (3 4))").bounds == Geometry.from_wkt("MULTIPOINT (1 2, 3 4)").bounds == (1, 2, 3, 4)
    assert Geometry.from_wkt("GEOMETRYCOLLECTION (POINT (0 0), LINESTRING (1 1, 2 2))").bounds == (0, 0, 2, 2)
    assert Geometry.from_wkt("POLYGON EMPTY").empty
    for bad in ("", "POINT", "POINT (1)", "CIRCLE (1 2)", "POINT (1 2) x", "POINT (1 2", "POINT {1 2}"):
        with pytest.raises(ValueError):
            Geometry.from_wkt(bad)


def test_geojson_geometry_feature_and_collection():
    g = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 5, 1]}}]}
    assert Geometry.from_geojson(g).to_wkt() == Geometry.from_geojson({"type": "Feature", "geometry": g}).to_wkt()
    assert Geometry.from_geojson(collection).bounds == (0, 0, 5, 5)


def test_rectangles_and_canonical_form():
    a = Geometry.polygon([(0, 0), (2, 0), (2, 1), (0, 1)])
    turned = Geometry.polygon([(2, 1), (2, 0), (0, 0), (0, 1)])
    extra = Geometry.polygon([(0, 0), (1, 0), (2, 0), (2, 1), (0, 1)])
    assert a.is_rectangle and extra.is_rectangle and not Geometry.polygon([(0, 0), (2, 0), (1, 1)]).is_rectangle
    assert not Geometry.union(a, Geometry.point(0, 0)).is_rectangle
    assert a.digest() == turned.digest() != Geometry.box(0, 0, 2, 2).digest()
    assert Geometry.union(a, Geometry.box(5, 5, 6, 6)).digest() == Geometry.union(Geometry.box(5, 5, 6, 6), turned).digest()


def test_hilbert_curve_visits_neighbours():
    n = 16
    xy = np.array([(x, y) for x in range(n) for y in range(n)])
    at = curve_position(xy[:, 0], xy[:, 1], 4)
    assert sorted(at) == list(range(n * n))
    steps = np.abs(np.diff(xy[np.argsort(at)], axis=0)).sum(1)
    assert steps.max() == 1


def test_cells():
    assert geohash_bounds("ezs42") == pytest.approx((-5.625, 42.5830078125, -5.5810546875, 42.626953125))
    assert geohash_bounds("EZS42") == geohash_bounds("ezs42")
    assert geohash_region("s, u").bounds == (0, 0, 45, 90)
    for bad in ("", "a1"):
        with pytest.raises(ValueError):
            geohash_bounds(bad)
    cell = s2_cell("12cdc28bc")  # a cell in Monaco
    assert cell.bounds == pytest.approx((7.4192, 43.7362, 7.4219, 43.7388), abs=1e-3)
    assert intersects(s2_cell("12cdc28f"), cell)
    assert s2_cell("1").bounds == pytest.approx((-45, -45, 45, 45), abs=11)
    for bad in ("", "zz", "f", "0"):
        with pytest.raises(ValueError):
            s2_cell(bad)
