"""Pairs of features of two tables, against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions.geometry import Geometry
from quadrille.functions.intersects import intersects
from quadrille.operators.spatial_join import spatial_join

SCHEMA = "id long, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, geometry binary, level string"


def frame(spark, boxes, geometry=lambda b: None):
    return spark.createDataFrame([(i, None if b is None else dict(zip(("xmin", "xmax", "ymin", "ymax"), b, strict=True)), geometry(b), "x") for i, b in enumerate(boxes)], SCHEMA)


def made(seed, n, crowd=0):
    """Boxes of all sizes, many on whole numbers, and a crowd of equal ones."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        x, y = (int(rng.integers(-180, 180)), int(rng.integers(-90, 90))) if rng.random() < 0.5 else (rng.uniform(-180, 180), rng.uniform(-90, 90))
        w, h = (10 ** rng.uniform(-7, 2.2, 2)) * (rng.random(2) > 0.2)
        out.append((float(x), float(x + w), float(y), float(y + h)))
    return out + [(10.0, 10.5, 20.0, 20.5)] * crowd


def meets(a, b):
    return a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3]


def all_pairs(left, right, test=meets):
    return sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and not any(map(math.isnan, (*a, *b))) and test(a, b))


def found(df):
    return sorted((r[0], r[1]) for r in df.select("left.id", "right.id").collect())


@pytest.mark.parametrize("seed", range(3))
def test_boxes(spark, seed):
    left, right = made(seed, 150), made(seed + 100, 150)
    assert found(spatial_join(frame(spark, left), frame(spark, right))) == all_pairs(left, right)


def test_crowded_cells_are_split(spark):
    left, right = made(1, 30, 300), [*made(2, 30, 40), (10.25, 10.25, 20.25, 20.25)]
    df = spatial_join(frame(spark, left), frame(spark, right), part=16)
    assert found(df) == all_pairs(left, right)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_points_and_touching_boxes(spark):
    points = [(float(x), float(x), float(y), float(y)) for x in range(-3, 4) for y in range(-3, 4)]
    right = [(-1.0, 1.0, -1.0, 1.0), (0.0, 0.0, 0.0, 0.0), (1.0, 2.0, 0.0, 90.0), (-180.0, 180.0, -90.0, 90.0)]
    assert found(spatial_join(frame(spark, points), frame(spark, right))) == all_pairs(points, right)


def test_odd_rows(spark):
    left = [None, (math.nan, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 1.0), (500.0, 900.0, -400.0, 400.0)]
    assert found(spatial_join(frame(spark, left), frame(spark, left))) == all_pairs(left, left)
    none = frame(spark, left).limit(0)
    assert spatial_join(frame(spark, left), none).count() == 0 and spatial_join(none, none).count() == 0
    assert spatial_join(frame(spark, left), frame(spark, left)).columns == ["left", "right"]


def test_exact(spark):
    left, right = made(7, 120), made(8, 60)
    point = lambda b: b and Geometry.point(b[0], b[2]).to_wkb()
    half = lambda b: b and Geometry.polygon([(b[0], b[2]), (b[1], b[2]), (b[0], b[3])]).to_wkb()
    line = lambda b: b and Geometry.line([(b[0], b[2]), (b[1], b[3])]).to_wkb()
    for one in (point, line):
        spots = [(b[0], b[0], b[2], b[2]) for b in left] if one is point else left
        test = lambda a, b, one=one: intersects(Geometry.from_wkb(one(a)), Geometry.from_wkb(half(b)))
        assert found(spatial_join(frame(spark, spots, one), frame(spark, right, half), exact=True)) == all_pairs(spots, right, lambda a, b, test=test: meets(a, b) and test(a, b))
    nulls = frame(spark, right, half).withColumn("geometry", F.when(F.col("id") % 2 == 0, F.col("geometry")))
    assert all(j % 2 == 0 for _, j in found(spatial_join(frame(spark, left, line), nulls, exact=True)))
