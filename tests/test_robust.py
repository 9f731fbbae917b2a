"""Orientation and intersects against exact fractions."""

from fractions import Fraction as Q

import numpy as np
import pytest

from quadrille.functions.geometry import Geometry
from quadrille.functions.intersects import in_polygon, intersects, on_segments, segments_meet
from quadrille.functions.robust import orientation


def exact(a, b, c):
    ax, ay, bx, by, cx, cy = (Q(float(v)) for v in (*a, *b, *c))
    d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (d > 0) - (d < 0)


def beside(rng, n):
    """Points on an edge but for the last bits."""
    a, b = rng.uniform(-180, 180, (n, 2)), rng.uniform(-180, 180, (n, 2))
    t = rng.uniform(-0.2, 1.2, (n, 1))
    c = a + t * (b - a)
    return a, b, c + rng.integers(-2, 3, (n, 2)) * np.spacing(np.abs(c))


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e9])
def test_orientation_is_exact(scale):
    a, b, c = (v * scale for v in beside(np.random.default_rng(3), 4000))
    got = orientation(a[:, 0], a[:, 1], b[:, 0], b[:, 1], c[:, 0], c[:, 1])
    assert got.tolist() == [exact(*p) for p in zip(a, b, c, strict=True)]
    assert {-1, 1} <= set(got.tolist())


def test_points_on_lines_of_whole_steps():
    a, b = np.array([0.1, 0.1]), np.array([0.7, 0.7])
    points = np.array([[i / 10, i / 10] for i in range(11)] + [[0.3, np.nextafter(0.3, 1)]])
    edge = np.hstack([a, b])[None]
    assert on_segments(points, edge).tolist() == [bool(exact(a, b, p) == 0 and a[0] <= p[0] <= b[0]) for p in points]


def brute_in(point, rings):
    x, y = Q(float(point[0])), Q(float(point[1]))
    odd = False
    for r in rings:
        for p, q in zip(r[:-1], r[1:], strict=True):
            (x0, y0), (x1, y1) = ((Q(float(v)) for v in e) for e in (p, q))
            d = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
            if d == 0 and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1):
                return True
            if (y0 > y) != (y1 > y) and x < x0 + (x1 - x0) * (y - y0) / (y1 - y0):
                odd = not odd
    return odd


@pytest.mark.parametrize("seed", range(4))
def test_points_beside_a_polygons_border(seed):
    rng = np.random.default_rng(seed)
    turn = np.sort(rng.uniform(0, 2 * np.pi, 12))
    ring = np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(1, 9, (12, 1))
    rings = Geometry.polygon(ring, ring * 0.3).polygons[0]
    near = [r[i] + t * (r[i + 1] - r[i]) for r in rings for i in range(len(r) - 1) for t in rng.uniform(0, 1, 20)]
    points = np.concatenate([rng.uniform(-9, 9, (100, 2)), near, *rings])
    points[: len(points) // 2] += rng.integers(-1, 2, (len(points) // 2, 2)) * np.spacing(points[: len(points) // 2])
    assert in_polygon(points, rings).tolist() == [brute_in(p, rings) for p in points]


def test_crossings(seed=7):
    rng = np.random.default_rng(seed)
    for _ in range(300):
        a, b, c = (v[0] for v in beside(rng, 1))
        d = rng.uniform(-180, 180, 2)
        one, two = np.hstack([a, b])[None], np.hstack([c, d])[None]
        boxes = (np.minimum(a, b) <= np.maximum(c, d)).all() and (np.minimum(c, d) <= np.maximum(a, b)).all()
        expected = boxes and exact(a, b, c) * exact(a, b, d) <= 0 and exact(c, d, a) * exact(c, d, b) <= 0
        assert segments_meet(one, two) == expected
        assert intersects(Geometry.line([a, b]), Geometry.line([c, d])) == expected
