"""Quality rules and a calibrated quality classifier.

Base figures are exact counts over the whole text.  The classifier is a
logistic regression over the shares of hashed word uni- and bigrams and
character 3-grams in a text, trained on labelled quality rows and calibrated by Platt
scaling on rows it was not fitted on, weighted back to the labels' true mix.
Texts are scored in Arrow batches against a fixed threshold.

Defined results: a null text counts as empty; a text without words fails the
base rules; without labelled rows of both kinds the classifier passes all.
Null and repeated ids and repeated rows are scored row by row, so no ties
arise; the threshold itself rejects; extra columns of any name are not read.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.arrays import SMALL_CHUNK, char_grams, chunks, row_sums, shingles, span_hashes, words
from quadrille.llm.learning import Sparse, calibrated, collected, drawn, each_once, held_out, logistic, sigmoid

#: Hash bits of each family of features.
BITS = 16
#: A text is kept if the calibrated probability of low quality is below this.
THRESHOLD = 0.5
#: Base limits: at least so many words; at most so many percent of repeated words.
MIN_WORDS, MAX_REPEATED = 50, 50
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_LEADS = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64)
_WHITE = b" \t\n\v\f\r"
#: Words of one text are told apart by hashes under a key of this process, so no text can be made to collide.
_KEY = secrets.randbits(64)


def repeated_words(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    out = np.zeros(n_docs, np.int64)
    counts = np.bincount(docs, minlength=n_docs)
    long = counts[docs] >= 3
    if not long.any():
        return out
    at = np.flatnonzero(long)
    own, grams = shingles(hashes[at], docs[at], n_docs, 3)
    # Windows come in order of position; the first of a text lies at its first word.
    firsts = np.cumsum(counts) - counts
    rank = np.arange(len(own)) - np.repeat(np.cumsum(np.bincount(own, minlength=n_docs)) - np.bincount(own, minlength=n_docs), np.bincount(own, minlength=n_docs))
    begin = firsts[own] + rank
    order = np.lexsort((grams, own))
    same = (own[order][1:] == own[order][:-1]) & (grams[order][1:] == grams[order][:-1])
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + 3, bool)
    for j in range(3):
        covered[begin[twice] + j] = True
    return np.bincount(docs, covered[: len(hashes)], n_docs).astype(np.int64)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    solid = [x for x in lines if x.strip(_WHITE)]
    return len(solid) - len(set(solid))


@dataclass
class Measures:
    """What a run of texts yields: base figures, and the parts of the features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEATED * self.n_words)


def measure(data: np.ndarray, offsets: np.ndarray) -> Measures:
    n = len(offsets) - 1
    starts, ends, docs = words(data, offsets)
    leads = np.concatenate([[0], np.cumsum(_LEADS[data])])
    marks = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    hashes = span_hashes(data, starts, ends, lower=False)
    raw = data.tobytes()
    dup = np.array([repeated_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
    top = np.uint64(64 - BITS)
    pair = docs[:-1] == docs[1:]
    both = (hashes[:-1] * np.uint64(3) + hashes[1:])[pair] * np.uint64(0x9E3779B97F4A7C15)
    grams = [(docs, (hashes >> top).astype(np.int64)), (docs[:-1][pair], (both >> top).astype(np.int64)), char_grams(data, offsets, 3, BITS)]
    return Measures(np.bincount(docs, minlength=n), row_sums(leads[ends] - leads[starts], docs, n).astype(np.int64), np.diff(marks[offsets]), dup, repeated_words(span_hashes(data, starts, ends, lower=False, key=_KEY), docs, n), grams)


@dataclass(frozen=True)
class QualityModel:
    """A weight for each bucket of each family, and the calibration of the sum of their means."""

    weights: tuple[np.ndarray, ...]
    slope: float
    bias: float

    def low(self, grams: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """The probability of low quality of each of n texts."""
        total = np.zeros(n)
        for (docs, codes), w in zip(grams, self.weights, strict=True):
            total += row_sums(w[codes], docs, n) / np.maximum(np.bincount(docs, minlength=n), 1)
        return sigmoid(self.slope * total + self.bias)


def _shares(texts: list[str]) -> Sparse:
    rows, columns, values, n = [], [], [], len(texts)
    for row, end, data, offsets in chunks(pa.array(texts, pa.large_string())):
        for family, (docs, codes) in enumerate(measure(data, offsets).grams):
            counts = np.bincount(docs, minlength=end - row)
            keys, times = np.unique((docs << BITS) + codes, return_counts=True)
            rows.append((row + (keys >> BITS)).astype(np.int32))
            columns.append(((keys & ((1 << BITS) - 1)) + (family << BITS)).astype(np.int32))
            values.append((times / counts[keys >> BITS]).astype(np.float32))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return Sparse(join(rows, np.int32), join(columns, np.int32), join(values, np.float32), (n, 3 << BITS))


def fit(texts: list[str], low: np.ndarray, weight: np.ndarray) -> QualityModel | None:
    """Four fifths of the rows fit the weights, the rest calibrate. None if either label is missing."""
    if not len(low) or low.min() == low.max():
        return None
    x = _shares(texts)
    fifth = np.arange(len(low)) % 5 == 4
    if min(low[fifth].sum(), (1 - low[fifth]).sum(), low[~fifth].sum(), (1 - low[~fifth]).sum()) < 1:
        fifth = np.zeros(len(low), bool)
    balance = np.where(low == 1, 0.5 / max(low.sum(), 1), 0.5 / max((1 - low).sum(), 1))
    w, b = logistic(x.take(~fifth), low[~fifth], balance[~fifth], ridge=1e-6, steps=60, rate=1.0)
    held = fifth if fifth.any() else ~fifth
    raw = x.take(held).dot(w) + b
    slope, bias = calibrated(raw, low[held].astype(float), weight[held])
    return QualityModel(tuple(w.reshape(3, -1)), slope, slope * b + bias)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 1500) -> QualityModel | None:
    """Fits on about `per_class` rows of each quality label (1 good, 0 low) among `usable` rows of `labels`; other labels are left out."""
    marked = labels.filter(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).filter("quality IN (0, 1)")
    chosen, counts = drawn(marked, "quality", F.col("doc_id"), per_class)
    ids = chosen.sparkSession.createDataFrame(collected(chosen, "doc_id", 3 * per_class), chosen.schema)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # at most 3 * per_class ids
    got = collected(each_once(rows, "quality", per_class), "doc_id", 4 * per_class)
    low = np.array([1 - r.quality for r in got], float)
    n = {q: max(1, int((low == 1 - q).sum())) for q in (0, 1)}
    weight = np.array([counts[r.quality] / n[r.quality] for r in got], float)
    return fit([r.text or "" for r in got], low, weight / max(weight.sum(), 1e-9) * len(got))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: QualityModel | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in `keep`, the base figures, base_failed, kept and p_low of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for row, end, data, offsets in chunks(texts, SMALL_CHUNK):
                found = measure(data, offsets)
                low = model.low(found.grams, end - row) if model else np.zeros(end - row)
                figures = [pa.array(getattr(found, name), pa.int64()) for name in FIGURES]
                failed = found.base_failed
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *figures, pa.array(failed), pa.array(~failed & (low < THRESHOLD)), pa.array(low)], [*names, *FIGURES, "base_failed", "kept", "p_low"])

    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    names = rows.columns[:-1]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(run, f"{kinds}, {', '.join(f'{x} long' for x in FIGURES)}, base_failed boolean, kept boolean, p_low double")
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def passes(text: Column, model: QualityModel | None) -> Column:
    """`kept` alone, as a column: only the texts go to Python, and only a flag comes back."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, bool)]
        for row, end, data, offsets in chunks(texts, SMALL_CHUNK):
            found = measure(data, offsets)
            low = model.low(found.grams, end - row) if model else np.zeros(end - row)
            out.append(~found.base_failed & (low < THRESHOLD))
        return pa.array(np.concatenate(out))

    return run(text.cast("string"))


def usable_labels() -> Column:
    """The labelled rows that are learned from; the other quarter measures the result."""
    return ~held_out(F.col("doc_id"))
