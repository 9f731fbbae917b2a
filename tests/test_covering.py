"""The covering decides as the exact test does, and leaves little to it."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions.covering import BORDER, INSIDE, OUTSIDE, covering
from quadrille.functions.geometry import Geometry
from quadrille.functions.intersects import in_polygon, intersects, points_in
from quadrille.operators.extract import extract


def coast(n, seed=1, size=8.0, at=(10.0, 45.0)):
    """A ragged ring of n points around `at`."""
    rng = np.random.default_rng(seed)
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = size * (1 + 0.3 * np.sin(3 * turn) + 0.05 * np.sin(41 * turn) + 0.002 * rng.standard_normal(n))
    return np.stack([at[0] + radius * np.cos(turn), at[1] + 0.6 * radius * np.sin(turn)], 1)


def regions():
    ring = coast(400)
    lake = coast(60, 2, 2.0)
    yield "ring", Geometry.polygon(ring)
    yield "hole", Geometry.polygon(ring, lake)
    yield "overlap", Geometry.union(Geometry.polygon(ring), Geometry.polygon(coast(50, 3, 3.0, (16.0, 45.0))), Geometry.box(0, 40, 4, 44))
    yield "mixed", Geometry.union(Geometry.polygon(lake), Geometry.line([(0, 40), (20, 50)]), Geometry.point(3.5, 47.25))
    yield "triangle", Geometry.polygon([(0, 40), (20, 41), (7, 52)])
    yield "flat", Geometry.line([(0, 45), (20, 45)])


@pytest.mark.parametrize("name, region", list(regions()))
def test_cells_are_of_one_kind(name, region):
    cover = covering(region)
    rng = np.random.default_rng(5)
    x0, y0, x1, y1 = region.bounds
    points = np.stack([rng.uniform(x0, x1, 4000), rng.uniform(y0, y1 + 1e-9, 4000)], 1)
    hit = points_in(points, region)
    column, row = np.floor((points[:, 0] - cover.x0) / cover.width).astype(int), np.floor((points[:, 1] - cover.y0) / cover.height).astype(int)
    n = len(cover.kinds)
    kinds = cover.kinds[np.clip(row, 0, n - 1), np.clip(column, 0, n - 1)]
    assert hit[kinds == INSIDE].all() and not hit[kinds == OUTSIDE].any()
    assert (cover.points_in(points) == hit).all()
    corners = np.concatenate([region.vertices, [(x0, y0), (x1, y1), (x0, y1), (x1, y0)]])
    assert (cover.points_in(corners) == points_in(corners, region)).all()


@pytest.mark.parametrize("name, region", list(regions()))
def test_geometries_near_the_border(name, region):
    cover, rng = covering(region), np.random.default_rng(11)
    for _ in range(150):
        x, y, size = rng.uniform(-2, 22), rng.uniform(38, 52), 10 ** rng.uniform(-3, 1.3)
        other = rng.choice([0, 1, 2])
        shape = Geometry.box(x, y, x + size, y + size) if other == 0 else Geometry.line([(x, y), (x + size, y - size / 3)]) if other == 1 else Geometry.polygon([(x, y), (x + size, y), (x, y + size)])
        assert cover.intersects(shape) == intersects(shape, region)


def test_many_edges_take_little_time():
    region = Geometry.polygon(coast(200_000))
    began = time.perf_counter()
    cover = covering(region)
    points = np.random.default_rng(1).uniform((0, 38), (20, 52), (200, 2))
    found = cover.points_in(points)
    assert time.perf_counter() - began < 20
    assert (found == in_polygon(points, region.polygons[0])).all()
    assert (cover.kinds == BORDER).mean() < 0.05


@pytest.mark.parametrize("float_boxes", [False, True])
def test_extract_sends_few_geometries_to_python(spark, float_boxes):
    """Same rows as the exact test alone, under 5 % of the geometries in Python."""
    region = Geometry.polygon(coast(20_000), coast(300, 2, 2.0))
    rng = np.random.default_rng(8)
    xy = rng.uniform((-1, 39), (21, 51), (20_000, 2))
    xy[:500] = region.vertices[::40][:500]
    kind = "float" if float_boxes else "double"
    rows = [(i, float(x), float(y), Geometry.point(x, y).to_wkb() if i % 97 else None) for i, (x, y) in enumerate(xy.tolist())]
    df = spark.createDataFrame(rows, "id long, x double, y double, geometry binary").withColumn("bbox", F.expr(f"named_struct('xmin', cast(x as {kind}), 'xmax', cast(x as {kind}), 'ymin', cast(y as {kind}), 'ymax', cast(y as {kind}))"))
    x0, y0, x1, y1 = region.bounds
    strict = [i for i, (x, y) in enumerate(xy.tolist()) if i % 97 and (np.float32(x) if float_boxes else x) > x0 and (np.float32(x) if float_boxes else x) < x1 and (np.float32(y) if float_boxes else y) > y0 and (np.float32(y) if float_boxes else y) < y1]
    hit = points_in(xy[strict], region)
    found = extract(df, region, columns=["x"])
    assert found.columns == ["id", "x", "geometry"]
    assert sorted(r.id for r in found.select("id").collect()) == [i for i, h in zip(strict, hit, strict=True) if h]
    cover = covering(region, float_boxes)
    assert df.where(F.col("id") >= 500).where(cover.kind() == BORDER).where(f"x > {x0} and x < {x1} and y > {y0} and y < {y1}").count() < 0.05 * 20_000
