"""SentencePiece encoding and decoding with byte-exact offsets.

The text is normalised here, not in the library: at each position the longest
key of the model's compiled character map (a double-array trie with its
replacement strings) is taken, and every byte written records the source byte
it came from; the longest of the model's user-defined symbols that starts there
stays as it is.  The library then segments the normalised text with a copy of
the model whose own normaliser is switched off.  The lengths of the pieces
cut the alignment into spans, so each piece projects to the bytes of the
original text it stands for, and consecutive spans tile the text.

Defined results: a null text counts as empty and gives only the end id; a
null or repeated doc_id gives one row per input row; columns beside doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from quadrille.llm.workspace import whole_ids

SPACE_MARK = "▁".encode()
_BYTE, _DEFINED, _CONTROL = 6, 4, 3


class CharMap:
    """The compiled character map: trie bytes length, double-array units, NUL-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units = np.zeros(0, np.uint32)
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.texts = blob[4 + size :]
        self.starts = np.zeros(256, bool)
        for first in range(1, 256) if len(self.units) else ():
            self.starts[first] = self._step(self._base(int(self.units[0]), 0), first) is not None

    @staticmethod
    def _base(unit: int, at: int) -> int:
        return at ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    def _step(self, at: int, byte: int) -> int | None:
        at ^= byte
        if at >= len(self.units) or (int(self.units[at]) & ((1 << 31) | 0xFF)) != byte:
            return None
        return at

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest key that starts at `at`."""
        best, node = None, self._base(int(self.units[0]), 0)
        for k in range(at, len(data)):
            here = self._step(node, data[k])
            if here is None:
                break
            unit = int(self.units[here])
            node = self._base(unit, here)
            if unit & (1 << 8):
                value = int(self.units[node]) & 0x7FFFFFFF
                best = (k + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return best


class OffsetCodec:
    """Encodes to (ids, begin, end) with byte spans in the original text, and decodes ids."""

    def __init__(self, model_file: str) -> None:
        with open(model_file, "rb") as f:
            blob = f.read()
        proto = model_pb2.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that mark spaces behind words are not supported")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.eos = self.whole.eos_id()
        self.lengths = np.array([0 if p.type == _CONTROL else 1 if p.type == _BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        symbols = sorted((p.piece.encode() for p in proto.pieces if p.type == _DEFINED), key=len, reverse=True)
        self.symbols = re.compile(b"|".join(map(re.escape, symbols))) if symbols else None
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.fallback = bool(proto.trainer_spec.byte_fallback)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, for each of them and the end the source byte offset)."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        if not self.squeeze and not self.map.starts[raw].any():
            return self._plain(raw)
        return self._mapped(data)

    def _plain(self, raw: np.ndarray) -> tuple[bytes, np.ndarray]:
        """No key of the map starts anywhere: only spaces are rewritten."""
        source = np.arange(len(raw) + 1, dtype=np.int64)
        if not self.escape:
            lead = b" " if self.prefix else b""
            return lead + raw.tobytes(), np.concatenate([np.zeros(len(lead), np.int64), source])
        lead = SPACE_MARK if self.prefix else b""
        times = np.where(raw == 32, len(SPACE_MARK), 1)
        source = np.concatenate([np.zeros(len(lead), np.int64), np.repeat(source[:-1], times), source[-1:]])
        return lead + raw.tobytes().replace(b" ", SPACE_MARK), source

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        mark = SPACE_MARK if self.escape else b" "
        out, source, at = bytearray(), [], 0
        starts = self.map.starts
        pieces = []
        while at < len(data):
            symbol = self.symbols.match(data, at) if self.symbols else None
            if symbol:
                hit = (symbol.end() - at, symbol[0])
            else:
                hit = self.map.longest(data, at) if starts[data[at]] else None
            if hit is None:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = (width, data[at : at + width])
            pieces.append((at, hit[1]))
            at += hit[0]
        end = len(data)
        if self.squeeze:
            while pieces and pieces[0][1].strip(b" ") == b"":
                pieces.pop(0)
        open_space = self.squeeze
        if self.prefix and pieces:
            out += mark
            source += [pieces[0][0]] * len(mark)
        for at, new in pieces:
            if open_space:
                new = new.lstrip(b" ")
            for byte in new:
                add = mark if byte == 32 else bytes([byte])
                out += add
                source += [at] * len(add)
            if new:
                open_space = self.squeeze and new.endswith(b" ")
        while self.squeeze and out.endswith(mark) and len(out) > 0:
            end = source[len(out) - len(mark)]
            del out[-len(mark) :], source[-len(mark) :]
        return bytes(out), np.array([*source, end], np.int64)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids without an end id, and each id's span of original bytes."""
        norm, source = self.normalise(text)
        ids = self.bare.encode(norm.decode()) if norm else []
        widths = self.lengths[ids]
        cuts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(widths, out=cuts[1:])
        if len(ids) and cuts[-1] != len(norm):
            if self.fallback:
                raise ValueError("pieces do not tile the normalised text")
            cuts = self._with_unknowns(norm)
        at = source[cuts]
        return ids, at[:-1], at[1:]

    def _with_unknowns(self, norm: bytes) -> np.ndarray:
        """Without byte fallback an unknown id covers as many bytes as its surface."""
        pieces = self.bare.encode(norm.decode(), out_type=str)
        return np.cumsum([0, *(len(p.encode()) for p in pieces)])

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


@lru_cache(maxsize=2)
def codec(model_file: str) -> OffsetCodec:
    return OffsetCodec(model_file)


def encode_documents(docs: DataFrame, model_file: str, end_id: bool = True) -> DataFrame:
    """doc_id, ids, begins, ends: token ids with the byte span each covers; the end id spans nothing at the end.

    Ids that are no whole numbers keep their type; the others are long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, begins, ends = [], [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    got, begin, end = own.encode(text)
                    stop = [len(text.encode())] * end_id
                    ids.append([*got, *[own.eos] * end_id])
                    begins.append([*begin.tolist(), *stop])
                    ends.append([*end.tolist(), *stop])
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, kind) for x in (ids, begins, ends))], ["doc_id", "ids", "begins", "ends"])

    name = F.col("doc_id").cast("long").alias("doc_id") if whole_ids(docs) else F.col("doc_id")
    chosen = docs.select(name, F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, ids array<int>, begins array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            texts = [own.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def encoding_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """The digest of each document's encoding and of what it decodes to.

    doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 (of the
    little-endian 64-bit begin offsets followed by the end offsets).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        names = [str(i) for i in range(own.whole.vocab_size())]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = []
                for text in part.column(1):
                    ids, begin, end = own.encode(text.as_py() or "")
                    ids.append(own.eos)
                    rows.append((len(ids), sha(" ".join([names[x] for x in ids]).encode()), sha(own.decode(ids).encode()), sha(begin.tobytes() + end.tobytes())))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(columns[0], pa.int64()), *(pa.array(x, pa.string()) for x in columns[1:])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
