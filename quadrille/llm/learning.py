"""What the trained operators share: bounded samples, folds and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.workspace import stored

#: Seeds the order in which labelled rows are drawn.
DRAW = 71
#: Bytes of text that a drawn sample may bring to the driver; a larger one is thinned by a hash of its key.
SAMPLE_BYTES = 128 << 20


def fold(doc_id: Column) -> Column:
    """crc32 of the id as decimal text, mod 4; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def drawn(rows: DataFrame, label: str, key: Column, per_class: int) -> tuple[DataFrame, dict]:
    """About `per_class` rows of each label, drawn by a hash of `key`, and the count of all rows by label.

    The counts cover all rows.  A label with fewer rows gives them all.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row for each label
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, min(1.0, per_class / n)).otherwise(share)
    unit = F.pmod(F.xxhash64(F.lit(DRAW), key), F.lit(1 << 30)) / (1 << 30)
    return rows.filter(unit < share), counts


def each_once(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """The drawn `rows` (doc_id, text, `label`); where ids repeat so that a label has over 2 * per_class rows, a bounded part of them.

    Ids are drawn to a bound, but each brings all rows that have it.  Beyond
    the bound each text of an id counts once, and about `per_class` of these
    are drawn for each label, by a hash of id and text.
    """
    if all(r[1] <= 2 * per_class for r in rows.groupBy(label).count().collect()):  # one row for each label
        return rows
    share = F.lit(0.0)
    for value, n in rows.groupBy(label).agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"))).collect():
        share = F.when(F.col(label) == value, min(1.0, per_class / n)).otherwise(share)
    unit = F.pmod(F.xxhash64(F.lit(DRAW + 2), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    return rows.filter(unit < share).distinct()


def collected(sample: DataFrame, key: str, bound: int) -> list:
    """The drawn rows on the driver, in an order that doesn't depend on partitions; `bound` rows and SAMPLE_BYTES of text at most."""
    if "text" in sample.columns:
        sample = stored(sample, "drawn")
        held = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if held > SAMPLE_BYTES:
            unit = F.pmod(F.xxhash64(F.lit(DRAW + 1), F.col(key)), F.lit(1 << 30)) / (1 << 30)
            sample = sample.filter(unit < SAMPLE_BYTES / held)
    return sample.orderBy(F.xxhash64(F.lit(DRAW), F.col(key)), *sample.columns).limit(bound).collect()


class Sparse:
    """Rows of (column, value), with the two products that gradient descent needs."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> None:
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns] * self.values, self.shape[0])

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, errors[self.rows] * self.values, self.shape[1])

    def take(self, keep: np.ndarray) -> Sparse:
        place = np.cumsum(keep) - 1
        own = keep[self.rows]
        return Sparse(place[self.rows[own]].astype(self.rows.dtype), self.columns[own], self.values[own], (int(keep.sum()), self.shape[1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def logistic(x: Sparse, target: np.ndarray, weight: np.ndarray, ridge: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the weighted logistic loss; targets may be probabilities."""
    w, b, total = np.zeros(x.shape[1]), 0.0, max(weight.sum(), 1e-12)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        error = weight * (sigmoid(x.dot(w) + b) - target) / total
        g, gb = x.back(error) + ridge * w, float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def calibrated(raw: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * raw + b): Platt scaling with smoothed targets, by Newton steps."""
    up, down = (weight * target).sum(), (weight * (1 - target)).sum()
    smooth = target * (up + 1) / (up + 2) + (1 - target) / (down + 2)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * raw + b)
        e, h = weight * (p - smooth), weight * p * (1 - p) + 1e-9
        g = np.array([(e * raw).sum() + 1e-6 * a, e.sum()])
        hess = np.array([[(h * raw * raw).sum() + 1e-6, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        scale = min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if np.isfinite(a) and a > 0 else (1.0, 0.0)
