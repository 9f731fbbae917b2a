"""Vectorised text primitives over Arrow batches (numpy only, no per-word Python).

A batch of texts is handled as one byte buffer with document offsets.  Every
function takes whole texts; chunking only bounds memory and never cuts a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: For operators whose arrays take some 100 bytes for each byte of text.
SMALL_CHUNK = 1 << 18

_MULT = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SEED = np.random.Generator(np.random.PCG64(20240607))
_PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: Each byte, A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
#: Spans up to so many bytes are hashed as arrays of 8-byte blocks; longer ones by BLAKE2b, one by one.
BLOCKED = 32
#: What to keep of a block that has so many bytes of its span.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts; null counts as empty."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, 8 * texts.offset)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


#: Bytes of words without punctuation: ASCII letters and digits, and all of longer characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray = ~_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each run of `kept` bytes; these are all but ASCII white space unless given."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = kept[data]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[first] |= solid[first]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    closes[last] |= solid[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _blocks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on."""
    return np.ndarray((len(data) + 1,), "<u8", data.tobytes() + bytes(8), 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span (A-Z as a-z if `lower`), the same wherever the span lies.

    The length, then each block of 8 bytes, goes through a bijective mixer, so
    spans of one length up to 8 bytes never collide and others do by chance
    alone: about n * n / 2**65 for n different spans.  Spans of more than
    BLOCKED bytes take BLAKE2b's first 64 bits.  Without knowledge of `key` no
    text can be made to collide.
    """
    if lower:
        data = FOLDED[data]
    blocks, sizes = _blocks(data), ends - starts
    out = mix(sizes.astype(np.uint64) * _MULT ^ np.uint64(key))
    active = np.flatnonzero(sizes <= BLOCKED)
    done = 0
    while len(active):
        left = sizes[active] - done
        out[active] = mix((out[active] ^ (blocks[starts[active] + done] & _KEPT[np.minimum(left, 8)])) * _MULT + np.uint64(1))
        active, done = active[left > 8], done + 8
    secret = key.to_bytes(8, "little")
    for i in np.flatnonzero(sizes > BLOCKED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Whether each span of `data` equals its span of `other`."""
    out = sizes == other_sizes
    mine, theirs = _blocks(data), _blocks(other)
    active = np.flatnonzero(out & (sizes <= BLOCKED))
    done = 0
    while len(active):
        left = sizes[active] - done
        equal = (mine[starts[active] + done] ^ theirs[other_starts[active] + done]) & _KEPT[np.minimum(left, 8)] == 0
        out[active[~equal]] = False
        active, done = active[equal & (left > 8)], done + 8
    for i in np.flatnonzero(out & (sizes > BLOCKED)).tolist():
        out[i] = np.array_equal(data[starts[i] : starts[i] + sizes[i]], other[other_starts[i] : other_starts[i] + sizes[i]])
    return out


def shingles(hashes: np.ndarray, docs: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every window of `width` words; a shorter document has its whole sequence as one."""
    counts = np.bincount(docs, minlength=n_docs)
    out_docs, out = [], []
    if len(hashes) >= width:
        full = len(hashes) - width + 1
        acc = np.zeros(full, np.uint64)
        for j in range(width):
            acc += hashes[j : j + full] * _PLACE[j]
        same = docs[:full] == docs[width - 1 :]
        out_docs.append(docs[:full][same])
        out.append(mix(acc[same]))
    firsts = np.cumsum(counts) - counts
    for length in range(1, width):
        few = np.flatnonzero(counts == length)
        if len(few):
            acc = np.full(len(few), np.uint64(length))
            for j in range(length):
                acc += hashes[firsts[few] + j] * _PLACE[j]
            out_docs.append(few)
            out.append(mix(acc ^ _MULT))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_docs), np.concatenate(out)


def distinct(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs sorted by document, then hash, each once."""
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    keep = np.ones(len(docs), bool)
    keep[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[keep], hashes[keep]


def listed(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of consecutive runs of `flat`."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def char_grams(data: np.ndarray, offsets: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket of 2**bits) of each run of `length` characters (three at most), A-Z as a-z; `data` is UTF-8."""
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(codes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    offsets = leads[offsets]
    codes[(codes >= 65) & (codes <= 90)] += np.uint64(32)
    full = len(codes) - length + 1
    packed = np.zeros(full, np.uint64)
    for j in range(length):
        packed = packed << np.uint64(21) | codes[j : j + full]
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    own = docs[:full] == docs[length - 1 :]
    return docs[:full][own], (mix(packed[own]) >> np.uint64(64 - bits)).astype(np.int64)


def byte_grams(data: np.ndarray, offsets: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket of 2**bits) of each run of `length` bytes, A-Z as a-z."""
    full = len(data) - length + 1
    if full <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = FOLDED[data].astype(np.uint64)
    acc = np.full(full, np.uint64(length))
    for j in range(length):
        acc = acc * np.uint64(257) + low[j : j + full]
    docs = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    begins = np.ones(len(data), bool)
    for j in range(1, length):
        at = offsets[1:] - j
        begins[at[at >= offsets[:-1]]] = False
    code = (acc * _MULT) >> np.uint64(64 - bits)
    return docs, code[begins[:full]].astype(np.int64)


def row_sums(values: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(docs, values, n_docs)
