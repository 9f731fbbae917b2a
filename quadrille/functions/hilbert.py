"""Positions along a Hilbert curve, as a vectorised column function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = 16


def curve_position(x: np.ndarray, y: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The distance along the curve of cells (x, y) of a 2**order grid."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for bit in range(order - 1, -1, -1):
        a, b = (x >> bit) & 1, (y >> bit) & 1
        out = (out << 2) | ((3 * a) ^ b)
        # In the lower half of the quadrant's row the axes swap; on its far side both flip.
        flip, low = (b == 0) & (a == 1), b == 0
        mask = (np.int64(1) << bit) - 1
        x, y = np.where(flip, mask - (x & mask), x & mask), np.where(flip, mask - (y & mask), y & mask)
        x, y = np.where(low, y, x), np.where(low, x, y)
    return out


def hilbert_key(x: Column, y: Column, extent: tuple[float, float, float, float], order: int = ORDER) -> Column:
    """The key of point (x, y) within (xmin, ymin, xmax, ymax); points beyond count as on the border, null as the first cell."""
    xmin, ymin, xmax, ymax = extent
    top = (1 << order) - 1

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        cells = []
        for v, lo, hi in ((x, xmin, xmax), (y, ymin, ymax)):
            share = (v.astype(float).fillna(lo).to_numpy() - lo) / ((hi - lo) or 1)
            cells.append(np.clip((share * (top + 1)).astype(np.int64), 0, top))
        return pd.Series(curve_position(*cells, order))

    return run(x, y)
