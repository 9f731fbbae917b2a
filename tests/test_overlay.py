"""Unions of polygons: against a grid of cells, exact areas and the parts themselves."""

import numpy as np
import pytest

from quadrille.functions.cells import geohash_bounds, geohash_region, s2_region
from quadrille.functions.geometry import Geometry
from quadrille.functions.intersects import points_in
from quadrille.functions.overlay import dissolved, union
from quadrille.sources import regions


def area(g):
    total = 0.0
    for rings in g.polygons:
        for k, r in enumerate(rings):
            x, y = (r - r[0]).T
            own = abs(0.5 * (x[:-1] * y[1:] - x[1:] * y[:-1]).sum())
            total += own if k == 0 else -own
    return total


def test_adjoining_boxes_are_a_rectangle():
    one, two = Geometry.box(0.1, 0.2, 0.3, 0.7), Geometry.box(0.3, 0.2, 1.1, 0.7)
    found = union([one, two])
    assert found.is_rectangle and found.digest() == Geometry.box(0.1, 0.2, 1.1, 0.7).digest()
    quarters = [Geometry.box(x / 10, y / 10, (x + 1) / 10, (y + 1) / 10) for x in range(5) for y in range(4)]
    assert union(quarters).digest() == Geometry.box(0, 0, 5 / 10, 4 / 10).digest()


def test_geohash_neighbours_take_the_box_path():
    pair = geohash_region("ezs40,ezs41")
    (a0, b0, _, _), (_, _, c1, d1) = geohash_bounds("ezs40"), geohash_bounds("ezs41")
    assert pair.is_rectangle and pair.digest() == Geometry.box(a0, b0, c1, d1).digest()
    assert not geohash_region("ezs40,ezs43").is_rectangle


@pytest.mark.parametrize("seed", range(25))
def test_boxes_match_a_grid(seed):
    rng = np.random.default_rng(seed)
    n = 9
    grid, boxes = np.zeros((n, n), bool), []
    for _ in range(rng.integers(2, 12)):
        x0, y0 = rng.integers(0, n - 1, 2)
        x1, y1 = x0 + rng.integers(1, n - x0 + 1), y0 + rng.integers(1, n - y0 + 1)
        x1, y1 = min(x1, x0 + 4), min(y1, y0 + 4)
        grid[y0:y1, x0:x1] = True
        boxes.append(Geometry.box(x0 / 7, y0 / 7, x1 / 7, y1 / 7))
    found = union(boxes)
    ys, xs = np.mgrid[0:n, 0:n]
    middles = np.stack([(xs.ravel() + 0.5) / 7, (ys.ravel() + 0.5) / 7], 1)
    assert (points_in(middles, found) == grid.ravel()).all()
    assert area(found) == pytest.approx(grid.sum() / 49)
    assert found.digest() == union(boxes[::-1]).digest()
    again = dissolved(found)
    assert again.digest() == found.digest()


@pytest.mark.parametrize("seed", range(25))
def test_any_polygons_hold_the_same_points(seed):
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(rng.integers(2, 7)):
        turn = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 9)))
        ring = np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(1, 3, (len(turn), 1)) + rng.uniform(-3, 3, 2)
        gap = np.diff(np.append(turn, turn[0] + 2 * np.pi)).max()
        parts.append(Geometry.polygon(ring, (ring - ring.mean(0)) * 0.2 + ring.mean(0)) if gap < 2.5 and rng.random() < 0.4 else Geometry.polygon(ring))
    bag, found = Geometry.union(*parts), union(parts)
    points = rng.uniform(-6, 6, (4000, 2))
    assert (points_in(points, found) == points_in(points, bag)).all()
    inner = [p for rings in found.polygons for r in rings for p in (r[:-1] + r[1:]) / 2]
    towards = np.array(inner)
    # Each border that is left has the outside on one side: points a little off it differ.
    for rings in found.polygons:
        for r in rings:
            d = r[1:] - r[:-1]
            off = np.stack([-d[:, 1], d[:, 0]], 1) / np.linalg.norm(d, axis=1)[:, None] * 1e-7
            middle = (r[:-1] + r[1:]) / 2
            long = np.linalg.norm(d, axis=1) > 1e-4
            assert (points_in(middle[long] + off[long], bag) != points_in(middle[long] - off[long], bag)).all()
    assert len(towards)


def test_holes_and_islands():
    frame = [Geometry.box(0, 0, 5, 1), Geometry.box(0, 4, 5, 5), Geometry.box(0, 0, 1, 5), Geometry.box(4, 0, 5, 5)]
    ring = union(frame)
    assert len(ring.polygons) == 1 and len(ring.polygons[0]) == 2 and area(ring) == 16
    with_island = union([*frame, Geometry.box(2, 2, 3, 3)])
    assert len(with_island.polygons) == 2 and area(with_island) == 17
    assert union([*frame, Geometry.box(1, 1, 4, 4)]).is_rectangle
    corner = union([Geometry.box(0, 0, 1, 1), Geometry.box(1, 1, 2, 2)])
    assert len(corner.polygons) == 2 and area(corner) == 2
    assert union([Geometry.box(0, 0, 2, 2), Geometry.box(0.5, 0.5, 1, 1)]).is_rectangle
    assert union([Geometry.box(0, 0, 1, 1)] * 3).digest() == Geometry.box(0, 0, 1, 1).digest()


def test_other_parts_stay():
    mixed = union([Geometry.box(0, 0, 1, 1), Geometry.point(5, 5), Geometry.line([(0, 0), (9, 9)]), Geometry.box(1, 0, 2, 1)])
    assert len(mixed.polygons) == 1 and len(mixed.points) == 1 and len(mixed.lines) == 1
    assert union([]).empty


def test_region_files_lose_inner_borders(tmp_path):
    path = tmp_path / "r.wkt"
    path.write_text("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))\nPOLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))\n")
    assert regions.from_file(str(path)).is_rectangle
    assert len(s2_region("89c25a31,89c25a33").polygons) <= 2
