"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be hit with up to k = floor(rate * m) edits.
Cut into k + 1 pieces, at least one piece of it stands unchanged in any such
hit, so an Aho-Corasick automaton over all pieces finds every place where an
item can be.  Runs of p neighbouring pieces obey the same rule with p - 1
edits, so a place is dropped as soon as a run on the way from the piece to the
whole item has more; this loses no hit.  Myers's bit-parallel algorithm checks
the runs and gives the least edit distance of the item to any substring around
the place.  Texts and items are compared lower-cased and with each run of
white space as one space.

Defined results: null or empty texts and items without visible characters hit
nothing; items under ten characters have no budget and are found letter by
letter alone; an item id that repeats is one item for each of its texts; rows
with a null doc_id are matched like others.  Each row of the documents gives
one row for each item found in it, at its place of least distance (the first,
of equals).  Extra columns of any name are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item.
RATE = 0.1
#: Characters of items in one automaton; more items take further passes over the texts.
ITEM_CHARS = 2_000_000
_SPACES = re.compile(r"\s+")


def folded(text: str) -> str:
    """Lower-cased character for character, runs of white space as one space, none at the ends."""
    return " ".join(text.translate(_SIMPLE).lower().split())


#: The character whose lower case is longer than itself, and the one whose lower case depends on what follows, with their simple lower case.
_SIMPLE = {0x130: "i", 0x3A3: "\u03c3"}


def runs_above(piece: int, count: int) -> list[tuple[int, int]]:
    """The runs of pieces (first, end), from the smallest, that halving `count` pieces puts above a piece; without the whole."""
    low, high, out = 0, count, []
    while high - low > 1:
        out.append((low, high))
        middle = (low + high) // 2
        low, high = (low, middle) if piece < middle else (middle, high)
    return out[:0:-1]


def pieces(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """(k, the k + 1 pieces with their offsets), as even as can be."""
    k = int(rate * len(item) + 1e-9)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass(frozen=True)
class Myers:
    """Least edit distance of a pattern to a substring of a text, 1 step for each character."""

    length: int
    masks: dict[str, int]

    @classmethod
    def of(cls, pattern: str) -> Myers:
        masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            masks[c] = masks.get(c, 0) | 1 << i
        return cls(len(pattern), masks)

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the first substring at the least distance."""
        full, top, get = (1 << self.length) - 1, 1 << (self.length - 1), self.masks.get
        up, down, score = full, 0, self.length
        least, end = score, 0
        for i, c in enumerate(text):
            eq = get(c, 0)
            x = eq | down
            d0 = (((x & up) + up) ^ up) | x
            hp = down | ~(d0 | up) & full
            hn = d0 & up
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
                if score < least:
                    least, end = score, i + 1
            # A match may begin anywhere, so no carry enters below the first row.
            hp = hp << 1 & full
            up = (hn << 1 | ~(d0 | hp)) & full
            down = hp & d0
        return least, end


def _automaton(places: dict[str, list]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, at in places.items():
        made.add_word(word, tuple(at))
    if places:
        made.make_automaton()
    return made


class Matcher:
    """All items of a block, ready to be looked for."""

    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        self.items = [(item_id, text) for item_id, raw in items if (text := folded(raw or ""))]
        self.forward = [Myers.of(text) for _, text in self.items]
        self.backward = [Myers.of(text[::-1]) for _, text in self.items]
        self.limits: list[int] = []
        self.above: dict[tuple[int, int], list[tuple[int, int, int, Myers]]] = {}
        found: dict[str, list[tuple[int, int, int]]] = {}
        for i, (_, text) in enumerate(self.items):
            k, parts = pieces(text, rate)
            self.limits.append(k)
            for j, (at, part) in enumerate(parts):
                found.setdefault(part, []).append((i, j, at + len(part)))
        self.runs: dict[str, Myers] = {}
        self.automaton = _automaton(found)
        same: dict[str, list[int]] = {}
        for i, (_, text) in enumerate(self.items):
            same.setdefault(text, []).append(i)
        self.whole = _automaton(same)

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, begin, end) in the folded text, for each item in it."""
        if not self.items or not text:
            return []
        # Items that stand there letter by letter need no more, however many share their pieces.
        exact: dict[int, int] = {}
        for end, same in self.whole.iter(text):
            for i in same:
                exact.setdefault(i, end + 1)
        out = [(i, 0, end - len(self.items[i][1]), end) for i, end in exact.items()]
        starts: dict[int, list[int]] = {}
        known: dict[tuple[int, int, int], int] = {}
        for end, places in self.automaton.iter(text):
            for i, j, behind in places:
                if i not in exact and self._stands(text, i, j, start := end + 1 - behind, known):
                    starts.setdefault(i, []).append(start)
        return out + [hit for i, at in starts.items() if (hit := self._verified(text, i, at))]

    def _stands(self, text: str, i: int, piece: int, start: int, known: dict[tuple[int, int, int], int]) -> bool:
        """Whether every run of pieces above the piece has few enough edits, the item's start taken at `start`; `known`: edits of runs at places of this text, which items share."""
        above = self.above.get((i, piece))
        if above is None:
            item, count = self.items[i][1], self.limits[i] + 1
            spans = [(len(item) * a // count, len(item) * b // count, b - a - 1) for a, b in runs_above(piece, count)]
            above = self.above[i, piece] = [(a - e, b + e, e, self._run(item[a:b])) for a, b, e in spans]
        for a, b, e, run in above:
            place = (id(run), max(0, start + a), max(0, start + b))
            if (edits := known.get(place)) is None:
                edits = known[place] = run.best(text[place[1] : place[2]])[0]
            if edits > e:
                return False
        return True

    def _run(self, text: str) -> Myers:
        """One object for each text."""
        return self.runs.setdefault(text, Myers.of(text))

    def _verified(self, text: str, i: int, starts: list[int]) -> tuple[int, int, int, int] | None:
        k, size = self.limits[i], len(self.items[i][1])
        best = None
        starts.sort()
        a = 0
        while a < len(starts):
            b = a
            while b + 1 < len(starts) and starts[b + 1] - starts[b] <= size + 2 * k:
                b += 1
            low, high = max(0, starts[a] - k), starts[b] + size + k
            edits, end = self.forward[i].best(text[low:high])
            if edits <= k and (best is None or edits < best[0]):
                best = (edits, low, low + end)
            a = b + 1
        if best is None:
            return None
        edits, low, end = best
        _, back = self.backward[i].best(text[low:end][::-1])
        return i, edits, end - back, end


def _origin(text: str) -> np.ndarray:
    """For each character of the folded text, and its end, the character of the text it comes from."""
    at = []
    for m in re.finditer(r"\S+", text):
        if at:
            at.append(at[-1] + 1)
        at.extend(range(m.start(), m.end()))
    return np.array([*at, at[-1] + 1 if at else 0])


def _blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ITEM_CHARS characters."""
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        if size > ITEM_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append((row.item_id, row.text or ""))
        size += len(row.text or "")
    return blocks


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, item_id, n_edits and the characters begin to end, for each item in each row of `docs` (text)."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    names = rows.columns[:-1]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    found = None
    for block in _blocks(items):
        part = rows.mapInArrow(_matching(block, rate, names), f"{kinds}, item_id long, n_edits int, begin long, end long")
        found = part if found is None else found.union(part)
    return found.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def _matching(block: list[tuple[int, str]], rate: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, rate)
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                text = text.as_py() or ""
                hits = matcher.hits(folded(text))
                origin = _origin(text) if hits else None
                for item, edits, begin, end in hits:
                    row.append(i)
                    found.append((matcher.items[item][0], edits, int(origin[begin]), int(origin[end - 1]) + 1))
            columns = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds))], [*names, "item_id", "n_edits", "begin", "end"])

    return run


def item_count(text: Column, items: DataFrame, rate: float = RATE) -> Column:
    """How many items each text holds, as a column: only the texts go to Python, and only a count comes back."""
    total = F.lit(0).cast("long")
    for block in _blocks(items):
        total = total + _counter(block, rate)(text.cast("string"))
    return total


def _counter(block: list[tuple[int, str]], rate: float):
    ready: list[Matcher] = []

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Matcher(block, rate))
        return pa.array([len(ready[0].hits(folded(t.as_py() or ""))) for t in texts], pa.int64())

    return run
