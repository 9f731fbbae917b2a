"""Language identification by string kernels.

The kernel of two texts is the number of blended-spectrum n-grams (1 to 3
bytes, A-Z folded, hashed to 2**BITS) present in both, over the geometric mean
of their own numbers.  Landmarks drawn from the labelled sample span a Nyström
feature space in which one ridge regression for each language separates it
from the rest.  Landmarks, whitening and regression fold into one matrix, so a
batch is scored by two matrix products.

Defined results: a text that is null or has no letter is `und` with score 0;
so is any text where no labelled row could be learned from.  Equal scores go
to the language first in byte order.  Rows are scored one by one, so a null or
repeated doc_id and repeated rows are kept as they are; extra columns of any
name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.arrays import byte_grams, chunks
from quadrille.llm.learning import DRAW, collected, drawn

#: Hash bits of an n-gram; the lengths of n-grams; texts in one matrix.
BITS, LENGTHS, ROWS = 13, (1, 2, 3), 256
UNKNOWN = "und"
#: Landmarks, at least and at most, if their number isn't given; rows that are drawn of all languages together.
LANDMARKS, SAMPLE_ROWS = (128, 1024), 25_600
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each text: which n-grams it has."""
    out = np.zeros((len(offsets) - 1, 1 << BITS), np.float32)
    flat = out.reshape(-1)
    for length in LENGTHS:
        docs, codes = byte_grams(data, offsets, length, BITS)
        flat[(docs << BITS) + codes] = 1
    return out


def presences(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, presence, number of n-grams) of a few texts each."""
    for i in range(0, len(texts), ROWS):
        for row, end, data, offsets in chunks(texts.slice(i, ROWS)):
            x = presence(data, offsets)
            yield i + row, i + end, x, np.maximum(x.sum(1), 1)


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    out = np.zeros(len(texts), bool)
    for row, end, data, offsets in chunks(texts):
        sums = np.concatenate([[0], np.cumsum(_LETTERS[data])])
        out[row:end] = np.diff(sums[offsets]) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Landmarks (rows of presences over the root of their sizes) and what their kernels weigh for each language."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks.T) / np.sqrt(sizes)[:, None] @ self.weights + self.bias


def fit(texts: list[str], labels: list[str], landmarks: int | None = None, ridge: float = 1e-3) -> LanguageModel:
    """Landmarks are the first texts of each language in turn; if not given, two of each language, LANDMARKS[0] at least and LANDMARKS[1] at most.

    Every language of the texts is learned, however many there are.
    """
    keep = lettered(pa.array(texts, pa.large_string()))
    texts, labels = [t for t, k in zip(texts, keep, strict=True) if k], [x for x, k in zip(labels, keep, strict=True) if k]
    names = tuple(sorted(set(labels)))
    if not names:
        return LanguageModel((), np.zeros((0, 1 << BITS), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    landmarks = landmarks or min(LANDMARKS[1], max(LANDMARKS[0], 2 * len(names)))
    seen: dict[str, int] = {}
    order = []
    for i, label in enumerate(labels):
        order.append((seen.setdefault(label, 0), label, i))
        seen[label] += 1
    chosen = [i for _, _, i in sorted(order)[:landmarks]]
    marks = np.concatenate([x / np.sqrt(n)[:, None] for _, _, x, n in presences(pa.array([texts[i] for i in chosen], pa.large_string()))])
    kernel = np.concatenate([(x @ marks.T) / np.sqrt(n)[:, None] for _, _, x, n in presences(pa.array(texts, pa.large_string()))]).astype(float)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = kernel @ whiten
    target = np.array([[x == name for name in names] for x in labels], float)
    share = np.array([1 / seen[x] for x in labels])[:, None]  # languages weigh alike
    share *= len(labels) / share.sum()
    mean_z, mean_y = (share * z).mean(0), (share * target).mean(0)
    zc, yc = z - mean_z, target - mean_y
    beta = np.linalg.solve(zc.T @ (share * zc) + ridge * len(z) * np.eye(z.shape[1]) / z.shape[1], zc.T @ (share * yc))
    return LanguageModel(names, marks.astype(np.float32), (whiten @ beta).astype(np.float32), (mean_y - mean_z @ beta).astype(np.float32))


def learn(docs: DataFrame, usable: Column, per_language: int = 400, sample: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on about `per_language` rows of each language among `usable` rows with a non-null lang, on fewer of each where all would be over `sample`.

    All languages are learned: each gives one row or more.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull()).select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    some, counts = drawn(rows, "lang", F.col("doc_id"), per_language)
    languages = max(1, len(counts))
    if per_language * languages > sample:
        per_language = max(1, sample // languages)
        some, _ = drawn(rows, "lang", F.col("doc_id"), per_language)
        # A draw by hash may leave out a language of which few rows are wanted: its first row is in, by the same hash.
        first = rows.groupBy("lang").agg(F.min_by(F.struct("doc_id", "text"), F.struct(F.xxhash64(F.lit(DRAW), "doc_id"), "text")).alias("r")).select("r.doc_id", "lang", "r.text")
        some = some.unionByName(first)
    got = collected(some, "doc_id", 2 * per_language * languages + languages)
    return fit([r.text or "" for r in got], [r.lang for r in got])


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, lang_pred and score of every row of `docs` (text)."""
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            pick, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for row, end, x, sizes in presences(texts) if model.languages else ():
                s = model.scores(x, sizes)
                pick[row:end], score[row:end] = s.argmax(1), np.clip(s.max(1), 0, 1)
            none = ~lettered(texts)
            pick[none], score[none] = len(names) - 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[pick], pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
