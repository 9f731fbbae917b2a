"""Signs of orientation that are exact for doubles: a filter in plain floats, exact sums where it can't tell."""

from __future__ import annotations

import math

import numpy as np

#: Fixed value: the relative error of the plain determinant, (3 + 16u)u for u = 2^-53.
_BOUND = (3 + 16 * 2.0**-53) * 2.0**-53
_SPLIT = 2.0**27 + 1


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b as a rounded product and its error."""
    p = a * b
    big_a, big_b = a * _SPLIT, b * _SPLIT
    high_a, high_b = big_a - (big_a - a), big_b - (big_b - b)
    low_a, low_b = a - high_a, b - high_b
    return p, low_a * low_b - (((p - high_a * high_b) - low_a * high_b) - high_a * low_b)


def orientation(ax, ay, bx, by, cx, cy) -> np.ndarray:
    """1 where c lies left of the way from a to b, -1 right of it, 0 on the line; arrays broadcast."""
    ax, ay, bx, by, cx, cy = np.broadcast_arrays(*(np.asarray(v, float) for v in (ax, ay, bx, by, cx, cy)))
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    det = left - right
    out = np.sign(det).astype(np.int8)
    unsure = np.flatnonzero((np.abs(det) <= _BOUND * (np.abs(left) + np.abs(right))).ravel())
    if len(unsure):
        x = [v.ravel()[unsure] for v in (ax, ay, bx, by, cx, cy)]
        # The determinant's six products, each with its error, summed without rounding.
        pairs = [_product(x[i], x[j]) for i, j in ((0, 3), (1, 4), (2, 5))] + [_product(-x[i], x[j]) for i, j in ((1, 2), (0, 5), (4, 3))]
        parts = np.stack([v for pair in pairs for v in pair], 1)
        flat = out.reshape(-1).copy()
        flat[unsure] = [0 if s == 0 else math.copysign(1, s) for s in map(math.fsum, parts.tolist())]
        out = flat.reshape(out.shape)
    return out
