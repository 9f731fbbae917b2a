"""Token ids as flat unsigned integer files with 64-bit document offsets.

A run writes into one folder, one set of files for each range of doc_id, in
ascending doc_id order:

    tokens-00007-<attempt>.bin   ids, little-endian, unsigned 16 or 32 bits
                                 (16 where the vocabulary and the end id fit)
    counts-00007-<attempt>.bin   ids of each document, unsigned 64 bits
    docids-00007-<attempt>.bin   doc_id of each document, signed 64 bits
    offsets-00007.bin            n + 1 offsets of documents in the whole run,
                                 unsigned 64 bits: the range's base plus sums
    manifest.json                dtype and, for each range, files, counts, bases

Bases are prefix sums over the ranges' totals, one row for each range.  Each
task attempt writes files of its own name and reports them with its totals,
so a task that runs twice leaves an unused file, never a mixed one.

Defined results: a null text counts as empty and has the end id alone; rows
with a null doc_id come first (stored as the smallest 64-bit integer, read as
null); rows that repeat a doc_id are kept, in order of their texts; extra
columns of any name are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.arrays import chunks, mix, same_bytes, span_hashes, words

#: Words of which a worker remembers the ids, and bytes of their texts and ids; beyond either the memory starts anew.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 64 << 20
_NO_ID = np.iinfo(np.int64).min
#: White space beside space, tab and newline by any version of Unicode, as code points.
_ODD = (*range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)
_ODD_SPACE = "[" + "".join(map(chr, _ODD)) + "]"

#: Marks that the library's pattern splits from the letters before them.
_MARKS = ",.;:!?"
#: Letters below this are letters in every version of Unicode.
_LATIN = chr(0x250)


class WordEncoder:
    """Byte-level BPE through the tokenizers library, by words.

    The library splits a text before it merges, and no split part runs from a
    visible character into white space.  So a space or newline and the visible
    characters behind it form a unit that encodes alike in any text.  A word
    that holds white space of other kinds, or an added token's string, does
    not stand alone.
    """

    def __init__(self, tokenizer_file: str, end_id: int | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        top = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD_SPACE, *added])).search
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_word = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.model = self.tokenizer.model
        shown = ByteLevel.alphabet()  # the characters that stand for bytes: visible Latin-1 for itself, the others from U+0100 on
        own = [b for b in range(256) if chr(b) in shown]
        others = iter(sorted(set(shown) - {chr(b) for b in own}))
        self.letters = {b: chr(b) if chr(b) in shown else next(others) for b in range(256)}
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.id_bytes = [np.array([i], self.dtype).tobytes() for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.marks = dict(zip(_MARKS, self._raw(list(_MARKS)), strict=True))

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes, with the end id."""
        return [b + self.end for b in self._raw(texts)]

    def units(self, units: list[str]) -> list[bytes | None]:
        """The ids of words with the space or newline before them; None for those that do not stand alone."""
        tokens, raw, letters, marks = self.model.tokenize, self.id_bytes, self.letters, self.marks
        out: list[bytes | None] = []
        rest = []
        for i, w in enumerate(units):
            core, tail = (w[1:-1], marks[w[-1]]) if w[-1] in marks else (w[1:], b"")
            # A space and letters, and a mark behind them, are what the library's pattern leaves in one piece each.
            if w[0] == " " and core.isalpha() and (core.isascii() or max(core) < _LATIN):
                out.append(b"".join([raw[t.id] for t in tokens((" " + core).encode().decode("latin-1").translate(letters))]) + tail)
            else:
                out.append(None)
                if not self.odd(w):
                    rest.append(i)
        for i, ids in zip(rest, self._raw([units[i] for i in rest]), strict=True):
            out[i] = ids
        return out


class _Table:
    """64-bit keys to consecutive numbers: linear probing, whole arrays at a time."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.entry = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that are not there."""
        slot = keys & self.mask
        out = self.entry[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + np.uint64(1)) & self.mask
            found = self.entry[slot]
            out[open_] = found
            again = (found >= 0) & (self.keys[slot] != keys[open_])
            open_, slot = open_[again], slot[again]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        slot = keys & self.mask
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[self.entry[slot[first]] < 0]
            self.keys[slot[first]], self.entry[slot[first]] = keys[first], numbers[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, numbers, slot = keys[rest], numbers[rest], (slot[rest] + np.uint64(1)) & self.mask


class ArrayEncoder:
    """Encodes Arrow batches of texts: words are found, hashed, looked up and replaced by their ids as arrays.

    Only words that the worker does not remember go to the library.  A word
    counts with what stands before it: nothing, a space or a newline; texts
    with other white space, or with a word that does not stand alone, are
    encoded one by one.  A word is looked up by 64 hash bits and then compared
    byte by byte; a text with a word that shares its hash with another is
    encoded by itself, so ids are the library's whatever the hash.
    """

    def __init__(self, words: WordEncoder) -> None:
        self.words = words
        self._forget()

    def _forget(self) -> None:
        self.table, self.n = _Table((4 * REMEMBERED - 1).bit_length()), 1
        # Entry 0 is the end of a text.
        end = np.frombuffer(self.words.end, self.words.dtype)
        self.flat, self.used = np.zeros(1 << 16, self.words.dtype), len(end)
        self.flat[: len(end)] = end
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.size[0], self.alone = len(end), np.ones(1 << 12, bool)
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        self.text_start, self.text_size, self.lead = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has)."""
        ids, counts = [np.zeros(0, self.words.dtype)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in chunks(texts):
            part, sizes = self._encode(data, offsets)
            ids.append(part)
            counts.append(sizes)
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        starts, ends, docs = words(data, offsets)
        plain = np.full(n, self.words.by_word)
        before = np.zeros(len(starts), np.uint64)
        if len(starts):
            first = np.ones(len(starts), bool)
            first[1:] = docs[1:] != docs[:-1]
            gap = starts - np.where(first, offsets[docs], np.roll(ends, 1))
            ahead = data[np.maximum(starts - 1, 0)]
            before = np.where(first, 0, np.where(ahead == 32, 1, 2)).astype(np.uint64)
            plain[docs[np.where(first, gap != 0, (gap != 1) | (ahead != 32) & (ahead != 10))]] = False
            last = np.flatnonzero(np.append(first[1:], True))
            plain[docs[last[ends[last] != offsets[docs[last] + 1]]]] = False
        plain[np.bincount(docs, minlength=n) == 0] &= (np.diff(offsets) == 0)[np.bincount(docs, minlength=n) == 0]
        own = plain[docs]
        starts, ends, docs, before = starts[own], ends[own], docs[own], before[own]
        keys = mix(span_hashes(data, starts, ends, lower=False) + before)
        entry = self.table.find(keys)
        if (entry < 0).any():
            if self.n > REMEMBERED or self.text_used + self.used * self.flat.itemsize > REMEMBERED_BYTES:
                self._forget()
                entry[:] = -1
            self._learn(data, starts, ends, before, keys, entry)
            entry = self.table.find(keys)
        known = (self.lead[entry] == before) & same_bytes(data, starts, ends - starts, self.text[: self.text_used], self.text_start[entry], self.text_size[entry])
        plain[docs[~known | ~self.alone[entry]]] = False
        # The end of each text goes behind its words.
        at = np.cumsum(np.bincount(docs, minlength=n))
        entry = np.insert(entry, at, 0)
        size = self.size[entry].astype(np.int64)
        total = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[entry] - total + size, size) + np.arange(total[-1] if len(total) else 0)]
        cuts = np.concatenate([[0], total[at + np.arange(n)]])
        if plain.all():
            return ids, np.diff(cuts)
        raw = data.tobytes()
        odd = np.flatnonzero(~plain)
        blobs = dict(zip(odd.tolist(), self.words.encode([raw[offsets[i] : offsets[i + 1]].decode() for i in odd]), strict=True))
        parts = [np.frombuffer(blobs[i], self.words.dtype) if i in blobs else ids[cuts[i] : cuts[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, keys: np.ndarray, entry: np.ndarray) -> None:
        missing = np.flatnonzero(entry < 0)
        new, first = np.unique(keys[missing], return_index=True)
        at = missing[first]
        raw, lead = data.tobytes(), ("", " ", "\n")
        units = [lead[b] + raw[s:e].decode() for s, e, b in zip(starts[at].tolist(), ends[at].tolist(), before[at].tolist(), strict=True)]
        found = self.words.units(units)
        sizes = np.array([0 if f is None else len(f) // self.words.dtype.itemsize for f in found], np.int64)
        flat = np.frombuffer(b"".join(f for f in found if f), self.words.dtype)
        self.flat = _grown(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        end = self.n + len(new)
        self.start, self.size, self.alone = (_grown(x, end) for x in (self.start, self.size, self.alone))
        self.start[self.n : end], self.size[self.n : end] = self.used + np.cumsum(sizes) - sizes, sizes
        self.alone[self.n : end] = [f is not None for f in found]
        self.text_start, self.text_size, self.lead = (_grown(x, end) for x in (self.text_start, self.text_size, self.lead))
        letters = ends[at] - starts[at]
        self.text_start[self.n : end], self.text_size[self.n : end], self.lead[self.n : end] = self.text_used + np.cumsum(letters) - letters, letters, before[at]
        self.text = _grown(self.text, self.text_used + int(letters.sum()))
        within = np.repeat(starts[at] - np.cumsum(letters) + letters, letters) + np.arange(int(letters.sum()))
        self.text[self.text_used : self.text_used + len(within)] = data[within]
        self.text_used += len(within)
        self.table.add(new, np.arange(self.n, end, dtype=np.int32))
        self.n, self.used = end, self.used + len(flat)


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


@lru_cache(maxsize=2)
def array_encoder(tokenizer_file: str, end_id: int | None) -> ArrayEncoder:
    return ArrayEncoder(encoder(tokenizer_file, end_id))


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, end_id: int | None) -> WordEncoder:
    return WordEncoder(tokenizer_file, end_id)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int | None = None) -> dict:
    """Encodes `docs` (doc_id, text) into `folder`, a URI that driver and executors share; returns the manifest."""
    spark = docs.sparkSession
    store, root = _opened(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = array_encoder(tokenizer_file, end_id)
        dtype = own.words.dtype
        store, root = _opened(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        name = lambda kind: f"{root}/{kind}-{part:05d}-{attempt}.bin"
        n_docs = n_ids = 0
        with store.open_output_stream(name("tokens")) as tokens, store.open_output_stream(name("counts")) as counts, store.open_output_stream(name("docids")) as docids:
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    rows = batch.slice(i, 1024)
                    ids, sizes = own.encode(rows.column(1))
                    tokens.write(ids.astype(dtype, copy=False).tobytes())
                    counts.write(sizes.astype("<u8").tobytes())
                    docids.write(rows.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    n_docs, n_ids = n_docs + len(sizes), n_ids + int(sizes.sum())
        yield pa.RecordBatch.from_pydict({"part": [part], "attempt": [attempt], "n_docs": [n_docs], "n_ids": [n_ids]}, pa.schema([("part", pa.int32()), ("attempt", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows of one doc_id are spread by how their texts begin.
    ordered = rows.repartitionByRange("doc_id", F.coalesce(F.substring("text", 1, 32), F.lit(""))).sortWithinPartitions("doc_id", "text")
    # One row for each range of doc_id, whatever the number of documents.
    totals = ordered.mapInArrow(write, "part int, attempt string, n_docs long, n_ids long").collect()
    done = sorted((r.part, r.attempt, r.n_docs, r.n_ids) for r in totals)
    parts, docs_before, ids_before = [], 0, 0
    for part, attempt, n_docs, n_ids in done:
        parts.append({"part": part, "attempt": attempt, "n_docs": n_docs, "n_ids": n_ids, "first_doc": docs_before, "first_id": ids_before})
        docs_before, ids_before = docs_before + n_docs, ids_before + n_ids
    manifest = {"dtype": encoder(tokenizer_file, end_id).dtype.str, "n_docs": docs_before, "n_ids": ids_before, "parts": parts}
    if parts:
        _table(spark, parts).foreachPartition(_offset_writer(folder))
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


_PART = "part int, attempt string, n_docs long, n_ids long, first_doc long, first_id long"


def _table(spark: SparkSession, parts: list[dict]) -> DataFrame:
    """A row for each range, spread over the cluster."""
    rows = [tuple(p[k.split()[0]] for k in _PART.split(", ")) for p in parts]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, min(len(rows), 4096))), _PART)


def _offset_writer(folder: str):
    def write(parts) -> None:
        store, root = _opened(folder)
        for p in parts:
            with store.open_input_file(f"{root}/counts-{p.part:05d}-{p.attempt}.bin") as f:
                counts = np.frombuffer(f.read(), "<u8")
            offsets = np.full(len(counts) + 1, p.first_id, "<u8")
            offsets[1:] += np.cumsum(counts, dtype="<u8")
            target = f"{root}/offsets-{p.part:05d}.bin"
            own = f"{target}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(offsets.tobytes())
            store.move(own, target)

    return write


class _Mapped:
    """A file as an array whose slices are copies: memory-mapped where the file system is local, else read range by range."""

    def __init__(self, store: fs.FileSystem, path: str, dtype: str) -> None:
        self.kind, self.file, self.map = np.dtype(dtype), None, None
        if isinstance(store, fs.LocalFileSystem):
            self.map = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        else:
            self.file = store.open_input_file(path)

    def __len__(self) -> int:
        return len(self.map) if self.map is not None else self.file.size() // self.kind.itemsize

    def part(self, begin: int, end: int) -> np.ndarray:
        if self.map is not None:
            return np.array(self.map[begin:end])
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((end - begin) * size, begin * size), self.kind)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32 bits) and, on demand, ids."""
    store, root = _opened(folder)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        for part in (p for b in batches for p in b.to_pylist()):
            ids = _Mapped(store, f"{root}/tokens-{part['part']:05d}-{part['attempt']}.bin", dtype)
            doc_ids = _Mapped(store, f"{root}/docids-{part['part']:05d}-{part['attempt']}.bin", "<i8")
            offsets = _Mapped(store, f"{root}/offsets-{part['part']:05d}.bin", "<u8")
            for i in range(0, len(doc_ids), 1024):
                own = doc_ids.part(i, min(i + 1024, len(doc_ids)))
                cuts = offsets.part(i, i + len(own) + 1).astype(np.int64)
                local = cuts - part["first_id"]
                flat = ids.part(int(local[0]), int(local[-1])).astype("<u4")
                at = local - local[0]
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [pa.array(own, pa.int64(), mask=own == _NO_ID), pa.array(cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return _table(spark, manifest["parts"]).mapInArrow(read, schema)
