"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

Every document's distinct shingles are ordered by how many documents hold
them, rarest first.  Documents whose Jaccard similarity reaches a threshold
share at least L of the first n - ceil(t * n) + L shingles of either, for any
L.  Each document takes the L for which scanning its postings and verifying
the candidates they lead to is estimated to cost least: where its prefix holds
common shingles, a longer prefix that asks for correspondingly more shared
shingles.  A pair is a candidate if the two prefixes share as many shingles as
the smaller of the two L.

Data flow, linear in the text: shingle hashes are packed into binary columns
and dealt once by hash range, where document frequencies are counted; only
shingles of two documents or more go on, dealt by document.  A shingle that
very many documents hold would fill one range: such shingles are counted block
by block beforehand, and their occurrences are dealt by document at once.  Exact copies (equal
sets) collapse into one representative.  Candidates are then found in two
ways.  Each document is compared with the central document (star) of the
posting lists it shares most of; documents of one star are compared through
their differences to it, which are small among near copies and mostly their
own, so groups of near copies meet in few pairs; documents of different stars
meet in the prefix postings.  Pairs that lie in one component already are never
formed.  Components are therefore those of the full join, without enumerating
the pairs inside a group.

Shingles are 64-bit hashes under a key drawn for the job, so no text can be
made to collide.  Ids keep 48 bits beside the hash range's, up to 63 (there are
four ranges for each shuffle partition, and more if a range would hold more
than RANGE_SHINGLES): that two different shingles of one pair of 400 shingles
each are taken for one has a chance of at most 3e-12, and with 2**15 ranges or
more of 2e-14.

Defined results: a text that is null or has no words has n_shingles 0, links
to nothing and is its own component; with fewer words than a shingle, the
whole sequence is one shingle.  A row whose doc_id is null keeps its
n_shingles and has a null component.  Repeated rows are copies; extra columns
of any name are not read.  Where a doc_id repeats, each row has the n_shingles
of its own text, and the rows are one document: what any of them links to is
linked with all of them.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.arrays import chunks, distinct, mix, shingles, span_hashes, words
from quadrille.llm.components import components
from quadrille.llm.workspace import stored

#: Shingles in a hash range that one task holds at once, about; bits of a range, at most.
RANGE_SHINGLES, MAX_BITS = 1 << 22, 24
#: Text bytes whose shingles are packed together.
BLOCK_BYTES = 3 << 20
#: A shingle is counted beforehand in blocks where this many documents or more hold it.
OFTEN = 3
#: Documents counted for a shingle from which on it is dealt by document; entries of the table of such shingles, at most.
HOT, HOT_TABLE = RANGE_SHINGLES // 4, 1 << 20
#: Classes into which the sizes of partners fall, at most, on either side.
CLASSES = 6
#: Largest L that a document considers; postings so few that none is sought.
MAX_MATCHES, FEW = 12, 16


@dataclass(frozen=True)
class JaccardJoin:
    """width: words in a shingle; percent: 100 * intersection >= percent * union links two sets; key: of the hashes."""

    width: int = 5
    percent: int = 80
    key: int = field(default_factory=lambda: secrets.randbits(64), repr=False, compare=False)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, shingle hash), sorted, each once."""
        starts, ends, docs = words(data, offsets)
        return distinct(*shingles(span_hashes(data, starts, ends, key=self.key), docs, len(offsets) - 1, self.width))


_PROFILES = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "d1", "d2")] + [("often", pa.binary())])


def profiles(docs: DataFrame, join: JaccardJoin) -> DataFrame:
    """doc_id, n, d1, d2: the size of each row's set and a 128-bit digest of it.

    Further rows, without n, count for each block of text the shingles that
    OFTEN documents of it or more hold: `often` has hashes, then counts, of 64 bits each.
    """

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(held)
        held.clear()
        hashes.sort()
        # Only those that stand again OFTEN - 1 places on are told apart and counted.
        again = hashes[: len(hashes) - OFTEN + 1][hashes[OFTEN - 1 :] == hashes[: len(hashes) - OFTEN + 1]] if len(hashes) >= OFTEN else hashes[:0]
        found, counts = np.unique(again, return_counts=True)
        blob = found.astype("<u8").tobytes() + (counts + OFTEN - 1).astype("<u8").tobytes()
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([blob], pa.binary())], schema=_PROFILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1)):
                own, hashes = join.sets(data, offsets)
                cuts = np.searchsorted(own, np.arange(end - row + 1))
                sums = []
                for tag in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(mix(hashes ^ np.uint64(tag)), out=total[1:])
                    sums.append(np.diff(total[cuts]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.diff(cuts).astype(np.int64)), *map(pa.array, sums), pa.nulls(end - row, pa.binary())], schema=_PROFILES)
                held.append(hashes)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield often(held)
                    size = 0
        if held:
            yield often(held)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, often binary")


def _hot(counted: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and levels of the shingles counted in `least` documents or more; counts are summed over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                hashes, counts = np.frombuffer(blob, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts)], ["h", "c"])

    sums = counted.filter("n IS NULL").select("often").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    found = sums.filter(F.col("c") >= least).toArrow()  # HOT_TABLE rows at most, by the choice of `least`
    hashes, counts = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], _level(counts[order])


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(4 * np.log2(counts))).astype(np.uint8)


def _squeeze(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _expand(blob: bytes, dtype: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _differences(ids: np.ndarray) -> np.ndarray:
    return np.diff(ids, prepend=np.int64(0))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each value of the first column, which come sorted by it."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if rows:
                    yield key, rows
                key, rows = row["key"], []
            rows.append(row)
    if rows:
        yield key, rows


def more_bits(bits: int) -> int:
    """Bits of a shingle's id between its range's and the last 32."""
    return min(16, 31 - bits)


def _packed_shingles(docs: DataFrame, join: JaccardJoin, bits: int, hot: np.ndarray, blocks: int) -> DataFrame:
    """key (the hash's first `bits` bits), n, high and low (the next more_bits(bits) and 32), doc (ids as differences): blocks of shingles.

    Occurrences of the shingles in `hot` have -1 less their document's block as key, and their place in `hot` as low.
    """
    schema = pa.schema([("key", pa.int32()), ("n", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("doc", pa.binary())])
    more = more_bits(bits)

    def pack(ids: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        doc, h = np.concatenate(ids), np.concatenate(hashes)
        ids.clear()
        hashes.clear()
        key = (h >> np.uint64(64 - bits)).astype(np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            own = hot[at] == h
            key[own] = -1 - _dealt(doc[own], blocks)
        order = np.argsort(key, kind="stable")
        doc, rest, key = doc[order], h[order] >> np.uint64(32 - bits - more), key[order]
        if len(hot):
            rest = np.where(own[order], at[order].astype(np.uint64), rest)
        low, high = rest.astype("<u4"), ((rest >> np.uint64(32)) & np.uint64((1 << more) - 1)).astype("<u2")
        keys, at = np.unique(key, return_index=True)
        cuts = [*at.tolist(), len(key)]
        parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([b - a for a, b in parts], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (high, low)), pa.array([_squeeze(_differences(doc[a:b])) for a, b in parts], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, held = [], [], 0
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, _, data, offsets in chunks(batch.column(1)):
                own, h = join.sets(data, offsets)
                ids.append(names[row + own])
                hashes.append(h)
                held += len(data)
                if held >= BLOCK_BYTES:
                    yield pack(ids, hashes)
                    held = 0
        if sum(map(len, ids)):
            yield pack(ids, hashes)

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "key int, n int, high binary, low binary, doc binary")


_SHARED = "key int, n int, low binary, high binary, level binary, doc binary"
_SHARED_ARROW = pa.schema([("key", pa.int32()), ("n", pa.int32()), *((k, pa.binary()) for k in ("low", "high", "level", "doc"))])


def _dealt(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _shared_shingles(packed: DataFrame, blocks: int, bits: int, hot: np.ndarray, levels: np.ndarray) -> DataFrame:
    """Occurrences of shingles that two rows or more hold, in blocks by document; level: 4 * log2 of how many hold it.

    Those in `hot` come by document already; they have the level in `levels`, the same for all documents.
    """
    more = more_bits(bits)
    hot_ids = (hot >> np.uint64(32 - bits - more)).astype(np.int64)

    def pack(parts: list[tuple]) -> pa.RecordBatch:
        doc, low, high, level = (np.concatenate(x) for x in zip(*parts, strict=True))
        block = _dealt(doc, blocks)
        order = np.lexsort((doc, block))
        doc, low, high, level, block = doc[order], low[order], high[order], level[order], block[order]
        keys, at = np.unique(block, return_index=True)
        cuts = [*at.tolist(), len(block)]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        columns = [[low[a:b].tobytes() for a, b in spans], *([_squeeze(x[a:b]) for a, b in spans] for x in (high, level)), [_squeeze(_differences(doc[a:b])) for a, b in spans]]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([b - a for a, b in spans], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], schema=_SHARED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for key, rows in _by_key(batches):
            if key < 0:
                at = np.concatenate([np.frombuffer(r["low"], "<u4") for r in rows])
                doc = np.concatenate([np.cumsum(_expand(r["doc"], "<i8", r["n"])) for r in rows])
                yield pack([(doc, hot_ids[at].astype("<u4"), (hot_ids[at] >> 32).astype("<u4"), levels[at])])
                continue
            ids = np.concatenate([np.frombuffer(r["low"], "<u4").astype(np.int64) | (np.frombuffer(r["high"], "<u2").astype(np.int64) << 32) for r in rows])
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = np.ones(len(ids), bool)
            first[1:] = ids[1:] != ids[:-1]
            group = np.cumsum(first) - 1
            counts = np.bincount(group)
            several = counts[group] >= 2
            doc = np.concatenate([np.cumsum(_expand(r["doc"], "<i8", r["n"])) for r in rows])[order][several]
            level = _level(counts)[group][several]
            ids = ids[several]
            parts.append((doc, ids.astype("<u4"), (ids >> 32 | key << more).astype("<u4"), level))
            held += len(doc)
            if held >= 1 << 20:
                yield pack(parts)
                parts, held = [], 0
        if held:
            yield pack(parts)

    return packed.repartition("key").sortWithinPartitions("key").mapInArrow(run, _SHARED)


def _packed_sizes(classes: DataFrame, blocks: int) -> DataFrame:
    """The representatives and their sizes, packed like shared shingles (low: the size; no high or level)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            block = _dealt(doc, blocks)
            order = np.lexsort((doc, block))
            doc, n, block = doc[order], n[order].astype("<u4"), block[order]
            keys, at = np.unique(block, return_index=True)
            cuts = [*at.tolist(), len(block)]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            none = pa.nulls(len(keys), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([b - a for a, b in spans], pa.int32()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()), none, none, pa.array([_squeeze(_differences(doc[a:b])) for a, b in spans], pa.binary())], schema=_SHARED_ARROW)

    return classes.select("rep", "n").mapInArrow(run, _SHARED)


def matches(n: int, rare: int, spread: np.ndarray, percent: int) -> tuple[int, int]:
    """(L, how many of the shared shingles lie in the prefix) at the least estimated cost.

    rare: shingles that no other document holds, which lead the order; spread:
    for each shared shingle in order, how many other documents hold it.  Every
    posting scanned counts 1; of the documents met, at most one in L shares L
    shingles, and verifying one counts n / 8.
    """
    least = -(-percent * n // 100)
    k = np.clip(n - least + np.arange(1, min(MAX_MATCHES, least) + 1) - rare, 0, len(spread))
    scanned = np.concatenate([[0], np.cumsum(spread)])[k]
    if scanned[0] <= FEW:
        return 1, int(k[0])
    best = int(np.argmin(scanned * (1 + n / 8 / np.arange(1, len(k) + 1))))
    return best + 1, int(k[best])


_CANDIDATES = "doc long, n int, least int, rarity int, prefix array<bigint>, shared binary"


def _candidates(shared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Representatives with a shared shingle in their prefix: size, L, prefix, and all shared shingles (ascending, 64 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            known = [r for r in rows if r["high"] is None]
            found = [r for r in rows if r["high"] is not None]
            if not known or not found:
                continue
            reps = np.concatenate([np.cumsum(_expand(r["doc"], "<i8", r["n"])) for r in known])
            size = np.concatenate([np.frombuffer(r["low"], "<u4") for r in known]).astype(np.int64)
            order = np.argsort(reps)
            reps, size = reps[order], size[order]
            doc = np.concatenate([np.cumsum(_expand(r["doc"], "<i8", r["n"])) for r in found])
            at = np.minimum(np.searchsorted(reps, doc), len(reps) - 1)
            own = reps[at] == doc
            token = (np.concatenate([_expand(r["high"], "<u4", r["n"]) for r in found]).astype(np.int64) << 32) | np.concatenate([np.frombuffer(r["low"], "<u4") for r in found])
            level = np.concatenate([_expand(r["level"], "u1", r["n"]) for r in found])
            at, token, level = at[own], token[own], level[own]
            order = np.lexsort((token, level, at))
            at, token, level = at[order], token[order], level[order]
            keep = np.ones(len(at), bool)  # a repeated row brings its shingles twice
            keep[1:] = (at[1:] != at[:-1]) | (token[1:] != token[:-1])
            at, token, level = at[keep], token[keep], level[keep]
            spread = 2.0 ** (level / 4) - 1
            cuts = np.searchsorted(at, np.arange(len(reps) + 1))
            out = []
            for i in np.flatnonzero(np.diff(cuts)):
                a, b, n = cuts[i], cuts[i + 1], int(size[i])
                rare = n - int(b - a)
                least, k = matches(n, rare, spread[a:b], percent)
                if k:
                    ids = np.sort(token[a:b])
                    out.append((int(reps[i]), n, least, 1000 * rare // n, token[a : a + k].tolist(), ids.astype("<i8").tobytes()))
            for i in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[i : i + 2000], strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["doc", "n", "least", "rarity", "prefix", "shared"])

    return shared.unionByName(sizes).repartition("key").sortWithinPartitions("key").mapInArrow(run, _CANDIDATES)


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


def _verified(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; shared shingles tell the whole intersection."""
    own = candidates.select("doc", "n", "shared")
    left, right = (own.select(*[F.col(c).alias(c + side) for c in own.columns]) for side in "ab")
    wide = pairs.join(left, pairs.a == left.doca).join(right, pairs.b == right.docb).select("a", "b", "na", "nb", "shareda", "sharedb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, na, nb, sa, sb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = len(np.intersect1d(_ids(sa), _ids(sb), assume_unique=True))
                if 100 * both >= percent * (na + nb - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return wide.mapInArrow(run, "a long, b long")


def _near_size(na, nb, percent: int):
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _assigned(postings: DataFrame, percent: int) -> DataFrame:
    """doc, star: each document with the central document of the posting lists it shares most of.

    The central document of a list has the smallest share of shingles of its
    own.  A central document that is itself assigned hands its documents on,
    twice, so that one group of near copies has one star.
    """
    heads = postings.groupBy("token").agg(F.min(F.struct("rarity", "doc", "n")).alias("head"), F.count("*").alias("held")).filter("held > 1")
    met = postings.join(heads, "token").filter((F.col("doc") != F.col("head.doc")) & _near_size(F.col("n"), F.col("head.n"), percent))
    counted = met.groupBy("doc", F.col("head.doc").alias("star")).count()
    one = stored(counted.groupBy("doc").agg(F.max_by("star", F.struct("count", F.negative("star").alias("first"))).alias("star")), "stars")
    for _ in range(2):
        above = one.select(F.col("doc").alias("star"), F.col("star").alias("top"))
        one = stored(one.join(above, "star", "left").select("doc", F.coalesce("top", "star").alias("star")), "stars")
    return one


_DIFFERENCES = "doc long, star long, star_n int, n int, linked boolean, rare int, size int, own array<bigint>"


def _differences_to(stars: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """What each document's set has and its star's has not, or the reverse, for documents at least half alike.

    size counts these shingles; rare of them are the document's alone; own
    lists the others (a shingle that only the star holds as -1, -2, ...).
    """
    left = candidates.select(*[F.col(c).alias(c + "a") for c in ("doc", "n", "shared")])
    right = candidates.select(*[F.col(c).alias(c + "b") for c in ("doc", "n", "shared")])
    wide = stars.join(left, stars.star == left.doca).join(right, stars.doc == right.docb).select("doc", "star", "na", "nb", "shareda", "sharedb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, star, na, nb, sa, sb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = _ids(sa), _ids(sb)
                own = np.setxor1d(a, b, assume_unique=True)
                both = (len(a) + len(b) - len(own)) // 2
                if 2 * both >= na + nb - both:
                    rare, others = nb - len(b), na - len(a)
                    out.append((doc, star, na, nb, 100 * both >= percent * (na + nb - both), rare, rare + others + len(own), [*own.tolist(), *range(-others, 0)]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["doc", "star", "star_n", "n", "linked", "rare", "size", "own"])

    return wide.mapInArrow(run, _DIFFERENCES)


def _mixed(placed: DataFrame, key: str) -> DataFrame:
    """The keys whose documents lie in several components so far."""
    return placed.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select(key)


def _placed(docs: DataFrame, roots: DataFrame) -> DataFrame:
    return docs.join(roots, docs.doc == roots.node, "left").withColumn("root", F.coalesce("root", "doc")).drop("node")


def _middle_pairs(differences: DataFrame, roots: DataFrame) -> DataFrame:
    """In each star with several components: its middle (fewest differences beside the star's own shingles) with the others."""
    placed = _placed(differences.select("doc", "star", F.expr("size - size(filter(own, x -> x < 0))").alias("far")), roots)
    open_ = stored(placed.join(_mixed(placed, "star"), "star", "left_semi"), "open")
    middle = open_.groupBy("star").agg(F.min(F.struct("far", "doc", "root")).alias("m"))
    return open_.join(middle, "star").filter(F.col("root") != F.col("m.root")).select(F.col("m.doc").alias("a"), F.col("doc").alias("b"))


def _star_pairs(differences: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Candidates among documents of one star in different components.

    Two sets differ in as many shingles as their differences to the star do,
    so a pair that reaches the threshold has at most d = (100 - percent) /
    (100 + percent) * (na + nb) of them.  Unless both reach the threshold with
    the star itself, their differences (of s <= l shingles) then share one at
    least, and one of the (s - l + d) / 2 + 1 and (l - s + d) / 2 + 1 that
    are rarest in the star.  Those prefixes are posted for each class of
    sizes that the other side may have.
    """
    placed = _placed(differences, roots)
    open_ = stored(placed.join(_mixed(placed.select("star", "root"), "star"), "star", "left_semi"), "open")
    each = open_.select("star", "doc", F.explode("own").alias("e"))
    often = each.groupBy("star", "e").count()
    ordered = each.join(often, ["star", "e"]).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("count", "e"))).alias("own"))
    rows = open_.drop("own").join(ordered, "doc", "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<count:bigint,e:bigint>>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("star", pa.int64()), ("e", pa.int64()), ("small", pa.int32()), ("large", pa.int32()), ("is_small", pa.bool_()), ("doc", pa.int64()), ("root", pa.int64())])
        for batch in batches:
            out = []
            for doc, star, star_n, n, rare, size, root, own in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc", "star", "star_n", "n", "rare", "size", "root", "own")), strict=True):
                # The largest d with any partner: its size is at most n * 100 / percent.
                most = n * (100 - percent) // percent
                # Classes are as wide in one star, and as few for long documents as for short ones.
                width = max(4, star_n * (100 - percent) // percent // CLASSES)
                mine = size // width
                for other in range(max(0, (size - most) // width), (size + most) // width + 1):
                    for small in (True, False):
                        if (other < mine) if small else (other > mine):
                            continue
                        # The partner's size in its class that asks for the longest prefix.
                        partner = max(size, other * width) if small else min(size, other * width)
                        length = (most - (partner - size) if small else most + size - partner) // 2 + 1
                        for one in own[: max(0, length - rare)]:
                            # A shingle that no other document of the star differs in meets nobody.
                            if one["count"] > 1:
                                out.append((star, one["e"], mine if small else other, other if small else mine, small, doc, root))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    posted = stored(rows.mapInArrow(run, "star long, e long, small int, large int, is_small boolean, doc long, root long"), "posted")
    key = ["star", "e", "small", "large"]
    a = posted.filter("is_small").select(*key, F.col("doc").alias("a"), F.col("root").alias("ra"))
    b = posted.filter("NOT is_small").select(*key, F.col("doc").alias("b"), F.col("root").alias("rb"))
    return a.join(b, key).filter("a <> b AND ra <> rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _other_pairs(postings: DataFrame, stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different stars (or of none) whose documents lie in different components so far."""
    placed = _placed(postings.join(stars, "doc", "left").withColumn("star", F.coalesce("star", "doc")), roots)
    placed = stored(placed.select("token", "doc", "n", "least", "star", "root"), "postings")
    held = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("star").alias("s0"), F.max("star").alias("s1"))
    open_ = placed.join(held.filter("lo <> hi AND s0 <> s1").select("token"), "token", "left_semi")
    a, b = (open_.select("token", *[F.col(c).alias(c + side) for c in ("doc", "n", "least", "star", "root")]) for side in "ab")
    met = a.join(b, "token").filter((F.col("doca") < F.col("docb")) & (F.col("stara") != F.col("starb")) & (F.col("roota") != F.col("rootb")) & _near_size(F.col("na"), F.col("nb"), percent))
    counted = met.groupBy("doca", "docb").agg(F.count("*").alias("both"), F.min(F.least("leasta", "leastb")).alias("needed"))
    return counted.filter("both >= needed").select(F.col("doca").alias("a"), F.col("docb").alias("b"))


def near_components(docs: DataFrame, join: JaccardJoin, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row of `docs` (doc_id, text).

    `hot` steers only which shingles are dealt by document; results don't depend on it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.filter(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _components_of(rows, join, hot)
    # Numbers of the rows' own, kept in a table, so that a row that is read again has the same one.
    numbered = stored(named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    found = _components_of(numbered.select(F.col("row").alias("doc_id"), "text"), join, hot).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("part"))
    found = stored(numbered.select("row", "doc_id").join(found, "row").select("doc_id", "n_shingles", "part"), "parts")
    out = _with_names(found)
    nameless = profiles(rows.filter(F.col("doc_id").isNull()), join).filter("n IS NOT NULL")
    return out.unionByName(nameless.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def _with_names(found: DataFrame) -> DataFrame:
    """Merges the parts (components of rows) that a doc_id's rows lie in, and names them by their smallest doc_id."""
    held = stored(found.select("doc_id", "part").distinct(), "held")
    first = held.groupBy("doc_id").agg(F.min("part").alias("a"))
    merged = components(held.join(first, "doc_id").filter("part <> a").select("a", F.col("part").alias("b")).distinct())
    placed = held.select("part", "doc_id").join(merged, held.part == merged.node, "left").select("part", "doc_id", F.coalesce("root", "part").alias("root"))
    placed = stored(placed, "placed")
    names = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = stored(placed.select("part", "root").distinct().join(names, "root").select("part", "component_id"), "names")
    return found.join(of, "part").select("doc_id", "n_shingles", "component_id")


def _components_of(rows: DataFrame, join: JaccardJoin, hot: int) -> DataFrame:
    """The same for `rows` (doc_id, text) whose ids, null apart, are unique."""
    spark = rows.sparkSession
    counted = stored(profiles(rows, join), "profiles")
    profile = counted.filter("n IS NOT NULL").drop("often")
    classes = stored(profile.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    total = profile.agg(F.sum("n")).first()[0] or 0
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_SHINGLES)
    bits = min(MAX_BITS, max(8, (ranges - 1).bit_length()))
    often, levels = _hot(counted, max(hot, total // HOT_TABLE))
    blocks = max(256, ranges)
    shared = _shared_shingles(_packed_shingles(rows.select("doc_id", "text"), join, bits, often, blocks), blocks, bits, often, levels)
    found = stored(_candidates(shared, _packed_sizes(classes, blocks), join.percent), "candidates")
    postings = stored(found.select(F.explode("prefix").alias("token"), "doc", "n", "least", "rarity"), "postings")
    differences = stored(_differences_to(_assigned(postings, join.percent), found, join.percent), "differences")
    links = differences.filter("linked").select(F.col("star").alias("a"), F.col("doc").alias("b"))
    roots = components(links)
    links = links.union(stored(_verified(_middle_pairs(differences, roots), found, join.percent), "links"))
    roots = components(links)
    pairs = _star_pairs(differences, roots, join.percent).union(_other_pairs(postings, differences.select("doc", "star").union(differences.select("star", "star").distinct()), roots, join.percent))
    others = stored(_verified(pairs, found, join.percent), "links")
    if not others.isEmpty():
        roots = components(links.union(others))
    placed = classes.join(roots, classes.rep == roots.node, "left").select("d1", "d2", F.coalesce("root", "rep").alias("root"))
    placed = stored(placed, "classes")
    return profile.join(placed, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))).alias("component_id"))
