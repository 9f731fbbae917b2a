"""Toxicity by weak supervision.

Voters speak or abstain: words of a stated lexicon, patterns, features that
labelled rows mark as telling, one that fires where all those are silent, and
the annotator whose labels the rows carry.  A generative label model over the
latent class estimates, by expectation maximisation to convergence, how often
each voter fires in either class (its accuracy) and how the voters hang
together given the class (a maximum spanning tree of conditional mutual
information); silence counts like a vote.  Its posteriors, not the labels,
train a linear classifier, and Platt scaling on the posteriors of rows that
nothing else was fitted on sets its scale.

The classifier reads how many different words of a text hold a feature: a run
of 4 to 7 bytes inside a word (its edges count as bytes), a longer whole word
or a pair of neighbouring words.  Each count is compared with what a clean
text of that many words has by chance, so a long text is not more
toxic than its parts; words written with digits or signs for letters are read
as letters too.

Data flow: the labelled rows are drawn to a documented bound, and features
are counted on executors.  The driver gets the telling features and, for each
drawn row, which of them it holds: never texts.  Copies among the drawn rows
share one row's weight.

Defined results: a null or empty text has the score of a text without any
telling word; without labelled rows of both kinds every text scores 0.  Rows
are scored one by one, so null or repeated ids and repeated rows are kept, and
ties can't arise; extra columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.arrays import ALNUM, SMALL_CHUNK, chunks, mix, span_hashes, words
from quadrille.llm.learning import Sparse, calibrated, drawn, each_once, logistic, sigmoid
from quadrille.llm.workspace import stored, whole_ids

THRESHOLD = 0.3
#: Lengths in bytes of the runs inside a word, edges included, that count as features.
GRAMS = (4, 5, 6, 7)
#: Different words that hold a feature: each of these numbers is a feature of its own.
TIMES = (1, 2, 3, 5)
#: Features that are weighed, at most: those that most toxic rows hold.
CANDIDATES = 1 << 16
#: How likely a row is toxic that the annotator marks toxic, or clean, at the start of the estimation.
AT_START = 0.95, 0.01
#: How much the rates at the start count beside those of the rows, in the label model.
ANCHOR = 1.0
#: How much of what it says counts when a voter is silent (voters of one language are silent in all others).
SILENCE = 0.4
#: Weight of the squared weights in the classifier's loss.
RIDGE = 1e-4
#: Drawn rows that must hold a feature; how far beyond chance (in deviations) it must lean to toxic.
SUPPORT, LEAN = 3, 3.0
#: Lexicon voters.
LEXICON = (
    "arrogant", "brainless", "clown", "contemptible", "coward", "cretin", "despicable", "dimwit", "disgrace", "disgusting", "dumb", "dunce", "filth",
    "fool", "freak", "garbage", "halfwit", "hateful", "idiot", "idiotic", "imbecile", "jerk", "lame", "liar", "loser", "lunatic", "moron", "moronic",
    "nasty", "parasite", "pathetic", "pig", "repulsive", "scum", "scumbag", "sicko", "slime", "stupid", "trash", "ugly", "vermin", "vile", "weirdo", "worthless",
)
#: Pattern voters, over lower-cased text.
PATTERNS = (r"\bshut up\b", r"\b(hate|despise) (you|them|him|her)\b", r"\byou (are|r) an? \w+", r"\bgo to hell\b", r"\b(kill|hurt) (yourself|you|them|him|her)\b", r"\bnobody (likes|wants) you\b", r"!{3,}")
#: Signs that stand for letters.
_SIGNS, _LETTERS = b"0134578@$!", b"oieastbasi"

_READ = np.arange(256, dtype=np.uint8)
_READ[list(_SIGNS)] = list(_LETTERS)
_SIGN = np.zeros(256, bool)
_SIGN[list(_SIGNS)] = True
_LETTER = ALNUM.copy()
_LETTER[48:58] = False
_SPELT = ALNUM | _SIGN
_WORD, _PAIR = np.uint64(1 << 63), np.uint64(3 << 62)
_LOW = np.uint64((1 << 62) - 1)


def word_name(word: str) -> int:
    """The feature of a whole word: its bytes with both edges where these are few, else a hash."""
    raw = f" {word} ".encode()
    if len(raw) <= max(GRAMS):
        return int.from_bytes(raw, "little")
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]), lower=False)[0] & _LOW | _WORD)


def _once(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each pair stands first."""
    order = np.lexsort((hashes, docs))
    new = np.ones(len(order), bool)
    new[1:] = (docs[order][1:] != docs[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    return order[new]


@dataclass
class Read:
    """What a run of texts holds: words of each, and (document, feature) of every different word, with repeats."""

    n_words: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]
    pairs: tuple[np.ndarray, np.ndarray]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, different words that hold it)."""
        docs, names = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((names, docs))
        docs, names = docs[order], names[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (names[1:] != names[:-1])
        at = np.flatnonzero(new)
        return docs[at], names[at], np.diff(np.append(at, len(docs)))


def lowered(texts: pa.Array) -> pa.Array:
    """Lower case by Unicode's simple mapping; null counts as empty."""
    return pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of single words, which are copied behind one another with an edge (a space) between them."""
    sizes = ends - starts
    if not len(sizes):
        return
    at = np.cumsum(sizes + 1) - sizes  # behind a first space
    flat = np.full(int(at[-1] + sizes[-1]) + 1, 32, np.uint8)
    within = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    flat[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(within))] = data[within]
    place = np.searchsorted(at, np.arange(len(flat)), "right") - 1  # the word a byte belongs to; an edge belongs to the word before it
    space = np.concatenate([[0], np.cumsum(flat == 32)])
    packed = np.zeros(len(flat), np.uint64)
    for j in range(max(GRAMS)):
        packed[: len(flat) - j] |= flat[j:].astype(np.uint64) << np.uint64(8 * j)
        if j + 1 not in GRAMS or len(flat) <= j:
            continue
        names = packed[: len(flat) - j]
        found = np.flatnonzero(near(names)) if near else np.arange(len(names))
        found = found[space[found + j] == space[found + 1]]  # no edge but at the ends
        # A run that starts with an edge belongs to the next word.
        yield docs[np.minimum(place[found] + (flat[found] == 32), len(docs) - 1)], names[found].copy()


def read(data: np.ndarray, offsets: np.ndarray, near=None) -> Read:
    """The features of lower-cased texts; `near` tells which are worth keeping."""
    starts, ends, docs = words(data, offsets, ALNUM)
    n_words = np.bincount(docs, minlength=len(offsets) - 1)
    hashes = span_hashes(data, starts, ends, lower=False)
    one = _once(docs, hashes)
    s, e, d = starts[one], ends[one], docs[one]
    parts = list(_grams(data, s, e, d, near))
    long = e - s + 2 > max(GRAMS)
    parts.append((d[long], hashes[one][long] & _LOW | _WORD))
    same = docs[1:] == docs[:-1]
    left, pair = docs[:-1][same], mix(hashes[:-1][same] * np.uint64(3) + hashes[1:][same]) & _LOW | _PAIR
    if near:
        kept = near(pair)
        left, pair = left[kept], pair[kept]
    one = _once(left, pair)
    pairs = left[one], pair[one]
    parts.append(pairs)
    # Words with a sign among letters, read as letters.
    if _SIGN[data].any():
        starts, ends, docs = words(data, offsets, _SPELT)
        signs, letters = (np.concatenate([[0], np.cumsum(kind[data])]) for kind in (_SIGN, _LETTER))
        ends = ends - (data[ends - 1] == 33)  # an exclamation mark behind a word stands for itself
        odd = (signs[ends] > signs[starts]) & (letters[ends] - letters[starts] >= 2)
        starts, ends, docs = starts[odd], ends[odd], docs[odd]
        spelt = _READ[data]
        hashes = span_hashes(spelt, starts, ends, lower=False)
        one = _once(docs, hashes)
        parts += _grams(spelt, starts[one], ends[one], docs[one], near)
        long = ends[one] - starts[one] + 2 > max(GRAMS)
        parts.append((docs[one][long], hashes[one][long] & _LOW | _WORD))
    return Read(n_words, parts, pairs)


class Vocabulary:
    """Finds which of a fixed set of features occur; a bitmap spares most look-ups."""

    def __init__(self, names: np.ndarray) -> None:
        self.names, self.place = np.unique(names, return_index=True)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.names)] = True

    @staticmethod
    def _slot(names: np.ndarray) -> np.ndarray:
        return ((names * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def near(self, names: np.ndarray) -> np.ndarray:
        return self.seen[self._slot(names)]

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each document, document, index into the names given, different words that hold it)."""
        got = read(data, offsets, self.near)
        docs, names, times = got.counted()
        at = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        hit = self.names[at] == names if len(self.names) else np.zeros(len(names), bool)
        return got.n_words, docs[hit], self.place[at[hit]], times[hit]


@dataclass(frozen=True)
class LabelModel:
    """P(voter fires | class, whether its parent fires), and each voter's parent in the tree (-1: none)."""

    prior: float
    parents: np.ndarray
    rates: np.ndarray  # [class, parent's vote, voter]
    steps: int = 0

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | all votes and silences)."""
        above = np.where(self.parents >= 0, votes[:, np.maximum(self.parents, 0)], 0).astype(int)
        ratio = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for y, sign in ((1, 1), (0, -1)):
            p = self.rates[y][above, np.arange(votes.shape[1])]
            ratio += sign * np.where(votes, np.log(p), SILENCE * np.log(1 - p)).sum(1)
        return sigmoid(np.clip(ratio, -40, 40))

    @property
    def accuracies(self) -> np.ndarray:
        """How likely the class is toxic where a voter fires and its parent doesn't."""
        up, down = self.prior * self.rates[1][0], (1 - self.prior) * self.rates[0][0]
        return up / (up + down)


def _tree(joint: list[np.ndarray], single: list[np.ndarray], share: list[float]) -> np.ndarray:
    """Parents in a maximum spanning tree of the voters' mutual information given the class."""
    m = len(single[0])
    info = np.zeros((m, m))
    for both, p, w in zip(joint, single, share, strict=True):
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = (p if a else 1 - p)[:, None], (p if b else 1 - p)[None, :]
                cell = np.clip(both if a and b else p[:, None] - both if a else p[None, :] - both if b else 1 - p[:, None] - p[None, :] + both, 1e-9, 1)
                info += w * cell * np.log(cell / np.clip(pa_ * pb, 1e-12, 1))
    parents, best, source, done = np.full(m, -1), np.full(m, -np.inf), np.full(m, -1), np.zeros(m, bool)
    here = 0
    for _ in range(m - 1):
        done[here] = True
        better = (info[here] > best) & ~done
        best[better], source[better] = info[here][better], here
        here = int(np.where(done, -np.inf, best).argmax())
        parents[here] = source[here]
    return parents


def fit_label_model(votes: np.ndarray, weight: np.ndarray, start: np.ndarray, prior: float, steps: int = 500) -> LabelModel:
    """Expectation maximisation from the posteriors in `start` until none moves by more than 0.001; rows weigh `weight`; the class prior is kept.

    The rates have a prior: those that `start` implies, which count ANCHOR
    times as much as the rows.  Without it the two classes drift to whatever
    splits the rows best, such as two languages.  No voter is worse than
    chance: one that would speak for the class it doesn't take at the start
    tells nothing until it does better.
    """
    v = votes.astype(float)
    takes = np.sign((weight * (start - np.average(start, weights=weight))) @ v)
    overall = (weight @ v + 0.5) / (weight.sum() + 1)

    def moments(r: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each class: weight, how often two voters fire together, and each alone (pulled to its overall rate by one row's weight)."""
        found = []
        for g in (weight * (1 - r), weight * r):
            total = g.sum() + 1
            found.append((total, (v.T @ (g[:, None] * v) + 1e-4) / total, (g @ v + overall) / total))
        return found

    anchor = moments(start)
    r = start
    for step in range(1, steps + 1):
        both = [[(ANCHOR * a + b) / (ANCHOR + 1) for a, b in zip(x, y, strict=True)] for x, y in zip(anchor, moments(r), strict=True)]
        share = np.array([x[0] for x in both])
        parents = _tree([x[1] for x in both], [x[2] for x in both], share / share.sum())
        up, rates = np.maximum(parents, 0), []
        for total, joint, p in both:
            fires = joint[up, np.arange(len(p))]
            on, off = p[up], 1 - p[up]
            given = np.stack([np.maximum(p - fires, 0) / np.maximum(off, 1e-9), fires / np.maximum(on, 1e-9)])
            mass = np.stack([off, on]) * total  # pulled to the rate without the parent by one row's weight
            given = (given * mass + p) / (mass + 1)
            rates.append(np.clip(np.where(parents >= 0, given, p), 1e-5, 1 - 1e-5))
        wrong = takes * (rates[1] - rates[0]) < 0
        pooled = (share[0] * rates[0] + share[1] * rates[1]) / share.sum()
        model = LabelModel(prior, parents, np.stack([np.where(wrong, pooled, x) for x in rates]), step)
        last, r = r, model.posterior(votes)
        if np.abs(r - last).max() < 1e-3:
            break
    return model


#: Chance rates are told apart by these steps: different words that hold a feature, for each word.
LEVELS = np.geomspace(1e-7, 1, 64)


def _level(rates: np.ndarray) -> np.ndarray:
    """The step next above each rate."""
    return np.minimum(np.searchsorted(LEVELS, rates), len(LEVELS) - 1)


def by_chance(n_words: np.ndarray, times: int) -> np.ndarray:
    """P(a feature of each step's rate is in `times` or more different words of a text of so many words)."""
    m = np.asarray(n_words, float)[:, None] * LEVELS
    term, below = np.exp(-m), np.zeros_like(m)
    for i in range(times):
        below += term
        term = term * m / (i + 1)
    return np.clip(1 - below, 0, 1)


class Beyond:
    """Presence of (feature, TIMES) columns less what chance gives a clean text of the same length."""

    def __init__(self, present: Sparse, n_words: np.ndarray, level: np.ndarray) -> None:
        self.present, self.n_words, self.level, self.shape = present, n_words, level, present.shape
        self.chance = _chances(n_words)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return self.present.dot(weights) - self.chance @ np.bincount(self.level, weights, self.chance.shape[1])

    def back(self, errors: np.ndarray) -> np.ndarray:
        return self.present.back(errors) - (errors @ self.chance)[self.level]

    def take(self, keep: np.ndarray) -> Beyond:
        return Beyond(self.present.take(keep), self.n_words[keep], self.level)


def _chances(n_words: np.ndarray) -> np.ndarray:
    return np.concatenate([by_chance(n_words, t) for t in TIMES], axis=1)


@dataclass(frozen=True)
class ToxicityModel:
    """names: features; weights [feature, TIMES]; base: for each step of chance and TIMES, the weights that lean on it."""

    names: np.ndarray
    weights: np.ndarray
    base: np.ndarray
    bias: float
    voters: int
    agreement: float
    steps: int

    def scorer(self):
        vocabulary = Vocabulary(self.names)
        # Holding a feature t times brings the weights of all TIMES up to t.
        upto = np.concatenate([np.zeros((len(self.names), 1)), np.cumsum(self.weights, 1)], 1)

        def score(texts: pa.Array) -> np.ndarray:
            out = [np.zeros(0)]
            for _, _, data, offsets in chunks(lowered(texts), SMALL_CHUNK):
                n_words, docs, at, times = vocabulary.found(data, offsets)
                raw = np.bincount(docs, upto[at, np.searchsorted(TIMES, times, "right")], len(n_words))
                out.append(sigmoid(raw - _chances(n_words) @ self.base + self.bias))
            return np.concatenate(out)

        return score


@dataclass
class Drawn:
    """The drawn rows as the driver sees them: label, weight (with copies sharing one), fold, words, patterns, features held."""

    toxic: np.ndarray
    weight: np.ndarray
    held: np.ndarray
    n_words: np.ndarray
    patterns: np.ndarray
    docs: np.ndarray
    at: np.ndarray
    times: np.ndarray


def chosen_features(up: np.ndarray, down: np.ndarray, toxic_words: np.ndarray, toxic_weight: np.ndarray, clean_words: np.ndarray, clean_weight: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, chance rates) of the features that lean to toxic: held by more toxic rows than their rate in clean rows explains.

    up and down: the weight of toxic and clean rows that hold each feature.
    """
    grid = by_chance(clean_words, 1)
    expected_down = clean_weight @ grid
    rate = np.exp(np.interp(np.log(down + 0.5), np.log(np.maximum(expected_down, 1e-12)), np.log(LEVELS)))
    expected = np.interp(np.log(rate), np.log(LEVELS), toxic_weight @ by_chance(toxic_words, 1))
    lean = (up - expected) / np.sqrt(expected + expected**2 / (down + 0.5) + 0.25)
    good = np.flatnonzero((lean > LEAN) & (up >= SUPPORT - 1e-6))
    return good[np.argsort(-lean[good], kind="stable")][:limit], rate


def _unlike(held: np.ndarray, limit: int) -> list[int]:
    """Columns in order, without those that fire in nearly the same rows as one before."""
    picked: list[int] = []
    size = held.sum(0).astype(float)
    for j in range(held.shape[1]):
        if len(picked) == limit:
            break
        both = (held[:, picked] & held[:, [j]]).sum(0)
        if not size[j] or (picked and (both / (size[picked] + size[j] - both)).max() >= 0.8):
            continue
        picked.append(j)
    return picked


def fit(rows: Drawn, names: np.ndarray, rates: np.ndarray, lexicon: np.ndarray, voters: int = 128) -> ToxicityModel:
    """names and rates: features, the telling ones by how far they lean; lexicon: the places of the lexicon's words behind them."""
    n, telling = len(rows.toxic), len(names) - len(lexicon)
    level = _level(rates)
    chance = [by_chance(rows.n_words, t) for t in TIMES]
    prior = float(np.clip((rows.weight * rows.toxic).sum() / rows.weight.sum(), 1e-3, 0.999))

    # Voters: a telling feature fires where its number of words is beyond chance.
    limit = np.full((n, len(LEVELS)), np.iinfo(np.int64).max)
    for t, p in sorted(zip(TIMES, chance, strict=True), reverse=True, key=lambda x: x[0]):
        limit[p < 0.05] = t
    fires = rows.times >= np.where(rows.at < telling, limit[rows.docs, level[rows.at]], 1)
    votes = np.zeros((n, len(names)), bool)
    votes[rows.docs[fires], rows.at[fires]] = True
    votes = np.column_stack([votes[:, _unlike(votes[:, : min(telling, 8 * voters)], voters)], votes[:, lexicon], rows.patterns])
    votes = votes[:, votes.any(0)]
    # One more speaks for clean: it fires where no other does. The annotator is a voter like the others; its votes start the estimation.
    votes = np.column_stack([votes, ~votes.any(1), rows.toxic == 1])
    model = fit_label_model(votes, rows.weight, np.where(rows.toxic == 1, *AT_START), prior)
    posterior = model.posterior(votes)

    # The classifier learns the posteriors.
    own = rows.at < telling
    docs, at, times = rows.docs[own], rows.at[own], rows.times[own]
    step = np.searchsorted(TIMES, times, "right")
    columns = at * len(TIMES)
    present = Sparse(np.repeat(docs, step), np.repeat(columns, step) + _ranks(step), np.ones(int(step.sum())), (n, telling * len(TIMES)))
    x = Beyond(present, rows.n_words, (np.arange(len(TIMES)) * len(LEVELS) + level[:telling, None]).ravel())
    train = ~rows.held
    w, b = logistic(x.take(train), posterior[train], rows.weight[train], ridge=RIDGE, steps=400, rate=0.05)
    held = rows.held if rows.held.any() else train
    slope, bias = calibrated(x.take(held).dot(w) + b, posterior[held], rows.weight[held])
    w = slope * w
    base = np.bincount(x.level, w, x.chance.shape[1])
    agreement = float(((posterior >= 0.5) == (rows.toxic == 1)).mean())
    return ToxicityModel(names[:telling], w.reshape(telling, len(TIMES)), base, slope * b + bias, votes.shape[1], agreement, model.steps)


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each c, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _copies(sketches: np.ndarray) -> np.ndarray:
    """For each row, how many rows share one of its sketches, at most."""
    times = np.ones(len(sketches))
    for column in sketches.T:
        _, code, count = np.unique(column, return_inverse=True, return_counts=True)
        times = np.maximum(times, count[code])
    return times


_NONE = np.iinfo(np.int64).min


def _sketched(sample: DataFrame) -> pa.Table:
    """Of each drawn row: id, label, fold, words, three minima of hashed word pairs, and the patterns that fire as bits."""
    columns = ["doc_id", "toxic", "held", "row", "n_words", "s0", "s1", "s2", "patterns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = lowered(batch.column(4))
            fired = np.stack([pc.match_substring_regex(low, p).to_numpy(zero_copy_only=False).astype(np.int64) << i for i, p in enumerate(PATTERNS)]).sum(0)
            for row, end, data, offsets in chunks(low):
                got, sketches = read(data, offsets), []
                docs, pairs = got.pairs
                for salt in (1, 2, 3):
                    values = (mix(pairs + np.uint64(salt)) >> np.uint64(1)).astype(np.int64)
                    order = np.lexsort((values, docs))
                    first = order[np.flatnonzero(np.diff(docs[order], prepend=-1))]
                    least = np.full(end - row, _NONE)
                    least[docs[first]] = values[first]
                    sketches.append(pa.array(least))
                yield pa.RecordBatch.from_arrays([*batch.slice(row, end - row).columns[:4], pa.array(got.n_words), *sketches, pa.array(fired[row:end])], columns)

    return sample.select("doc_id", "toxic", "held", "row", "text").mapInArrow(run, "doc_id long, toxic int, held boolean, row long, n_words long, s0 long, s1 long, s2 long, patterns long").toArrow()


def _tallied(sample: DataFrame, weights: dict[int, float], names: np.ndarray | None) -> DataFrame:
    """name, up, down: the weight of the toxic and of the clean rows that hold each feature (of `names`, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(names) if names is not None else None
        for batch in batches:
            weight = np.array([weights[i] for i in batch.column(0).to_pylist()])
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, end, data, offsets in chunks(lowered(batch.column(2))):
                if own:
                    _, docs, at, _ = own.found(data, offsets)
                    found = names[at]
                else:
                    docs, found, _ = read(data, offsets).counted()
                kinds, code = np.unique(found, return_inverse=True)
                sums = [np.bincount(code, weight[row + docs] * (toxic[row + docs] == y), len(kinds)) for y in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), *map(pa.array, sums)], ["name", "up", "down"])

    parts = sample.select("doc_id", "toxic", "text").mapInArrow(run, "name long, up double, down double")
    return parts.groupBy("name").agg(F.round(F.sum("up"), 6).alias("up"), F.round(F.sum("down"), 6).alias("down"))


def _holdings(sample: DataFrame, names: np.ndarray) -> pa.Table:
    """row, at, times: which of `names` each drawn row holds, and in how many different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(names)
        for batch in batches:
            for row, end, data, offsets in chunks(lowered(batch.column(1))):
                _, docs, at, times = own.found(data, offsets)
                cuts = np.searchsorted(docs, np.arange(end - row + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (at, np.minimum(times, 1 << 20))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *lists], ["row", "at", "times"])

    return sample.select("row", "text").mapInArrow(run, "row long, at array<int>, times array<int>").toArrow()


def drawn_rows(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int) -> tuple[DataFrame, dict]:
    """doc_id, toxic, held, text and number of about `per_class` rows of each label, and the count of all labelled rows by label.

    Ids that are no whole numbers, such as texts, have a 64-bit hash as doc_id.
    """
    own = F.col("doc_id").cast("long").alias("doc_id") if whole_ids(docs) and whole_ids(labels) else F.col("doc_id")
    marked = labels.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy(own).agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)")
    chosen, counts = drawn(marked, "toxic", F.col("doc_id"), per_class)
    rows = docs.select(own, F.col("text").cast("string").alias("text"))
    # The drawn ids number about 2 * per_class, whatever the tables; their rows do too, as ids may repeat.
    rows = each_once(rows.join(F.broadcast(chosen), "doc_id"), "toxic", per_class).withColumn("held", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)) == 4)
    if not whole_ids(rows):
        rows = rows.withColumn("doc_id", F.xxhash64("doc_id"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "drawn"), counts


def learn(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 3000, features: int = 2048) -> ToxicityModel | None:
    """Fits on about `per_class` rows of each toxic label among `usable` rows of `labels`, with `features` features at most."""
    sample, counts = drawn_rows(docs, labels, usable, per_class)
    seen = _sketched(sample).sort_by([("doc_id", "ascending"), *((k, "ascending") for k in ("n_words", "s0", "s1", "s2", "patterns", "row"))])
    ids, toxic, held, numbers, n_words, *sketches, patterns = (seen.column(i).to_numpy() for i in range(9))
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    held = held.astype(bool)
    if min((toxic[f] == y).sum() for f in (held, ~held) for y in (0, 1)) < 5:
        held = np.zeros(len(held), bool)
    share = 1 / _copies(np.stack(sketches, 1))
    weights: dict[int, float] = {}
    for i, w in zip(ids.tolist(), share.tolist(), strict=True):
        weights[i] = min(w, weights.get(i, 1.0))

    # Features are chosen on the rows that fit; the others calibrate.
    fitting = sample.filter("NOT held") if held.any() else sample
    candidates = _tallied(fitting.filter("toxic = 1"), weights, None).filter(f"up >= {SUPPORT} - 1e-6").orderBy(F.desc("up"), "name").limit(CANDIDATES).toArrow()
    names = candidates.column("name").to_numpy().view(np.uint64)
    tally = _tallied(fitting, weights, names).toArrow().sort_by("name") if len(names) else candidates
    names, up, down = tally.column("name").to_numpy().view(np.uint64), tally.column("up").to_numpy(), tally.column("down").to_numpy()
    up_rows, down_rows = ~held & (toxic == 1), ~held & (toxic == 0)
    places, rates = chosen_features(up, down, n_words[up_rows], share[up_rows], n_words[down_rows], share[down_rows], features)
    lexicon = np.array([word_name(w) for w in LEXICON], np.uint64)
    extra = lexicon[~np.isin(lexicon, names[places])]
    known = np.concatenate([names[places], extra])
    held_features = _holdings(sample, known)

    # The driver's rows come in another order than the features'; the sample's row numbers tell which is which.
    order = numbers.argsort()
    row_of = order[np.searchsorted(numbers, held_features.column("row").to_numpy(), sorter=order)]
    sizes = np.diff(held_features.column("at").combine_chunks().offsets.to_numpy()) if len(numbers) else np.zeros(0, np.int64)
    flat = [held_features.column(k).combine_chunks().flatten().to_numpy() for k in ("at", "times")]
    n = {t: max(1e-9, share[toxic == t].sum()) for t in (0, 1)}
    weight = share * np.array([counts[t] / n[t] for t in toxic.tolist()])
    rows = Drawn(
        toxic.astype(float), weight / max(weight.sum(), 1e-9) * share.sum(), held, n_words,
        (patterns[:, None] >> np.arange(len(PATTERNS)) & 1).astype(bool), np.repeat(row_of, sizes), flat[0], flat[1],
    )
    return fit(rows, known, np.concatenate([rates[places], np.full(len(extra), LEVELS[0])]), np.arange(len(places), len(known)))


def score(docs: DataFrame, model: ToxicityModel | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in `keep`, score and predicted (1 from THRESHOLD on) of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.scorer() if model else None
        for batch in batches:
            s = own(batch.column(batch.num_columns - 1)) if own else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    names = rows.columns[:-1]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int").withColumnsRenamed(dict(zip(names, keep, strict=True)))


def is_toxic(text: Column, model: ToxicityModel | None) -> Column:
    """`predicted` alone, as a boolean column: only the texts go to Python, and only a flag comes back."""
    ready: list = []

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(texts), bool))
        if not ready:
            ready.append(model.scorer())
        return pa.array(ready[0](texts) >= THRESHOLD)

    return run(text.cast("string"))
