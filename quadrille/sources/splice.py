"""One Parquet file of many by copying their bytes: row groups stay as they are written, the footer is made anew.

Footers are structs of Thrift's compact protocol.  They are read into plain
lists of (field, kind, value), the offsets in them are moved, and they are
written again; pages are never decoded, so memory doesn't grow with the data.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from typing import Any, BinaryIO

from pyarrow import fs

MAGIC = b"PAR1"
#: Bytes that are copied at once.
STEP = 8 << 20

# Kinds of the compact protocol, and fields of Parquet's footer that matter here.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
ROWS, GROUPS, KEYS, CREATED = 3, 4, 5, 6
GROUP_COLUMNS, GROUP_OFFSET, GROUP_ORDINAL = 1, 5, 7
CHUNK_OFFSET, CHUNK_META, CHUNK_INDEXES = 2, 3, (4, 6)
PAGE_OFFSETS = (9, 10, 11, 14)

Struct = list[tuple[int, int, Any]]


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int) -> Any:
        if kind in (TRUE, FALSE):  # in a list; a field's truth is its kind
            return self.byte()
        if kind == BYTE:
            return self.byte()
        if kind in (I16, I32, I64):
            n = self.varint()
            return n >> 1 ^ -(n & 1)
        if kind == DOUBLE:
            return self.raw(8)
        if kind == BINARY:
            return self.raw(self.varint())
        if kind in (LIST, SET):
            head = self.byte()
            n = head >> 4 if head >> 4 < 15 else self.varint()
            return head & 15, [self.value(head & 15) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"kind {kind} doesn't occur in footers")

    def struct(self) -> Struct:
        out, last = [], 0
        while head := self.byte():
            kind = head & 15
            if head >> 4:
                last += head >> 4
            else:
                n = self.varint()
                last = n >> 1 ^ -(n & 1)
            out.append((last, kind, None if kind in (TRUE, FALSE) else self.value(kind)))
        return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _zigzag(n: int) -> bytes:
    return _varint(n << 1 ^ n >> 63)


def _written(kind: int, value: Any) -> bytes:
    if kind in (TRUE, FALSE, BYTE):
        return bytes([value])
    if kind in (I16, I32, I64):
        return _zigzag(value)
    if kind == DOUBLE:
        return value
    if kind == BINARY:
        return _varint(len(value)) + value
    if kind in (LIST, SET):
        of, items = value
        head = bytes([len(items) << 4 | of]) if len(items) < 15 else bytes([0xF0 | of]) + _varint(len(items))
        return head + b"".join(_written(of, x) for x in items)
    return _struct(value)


def _struct(fields: Struct) -> bytes:
    out, last = [], 0
    for number, kind, value in fields:
        step = number - last
        out.append(bytes([step << 4 | kind]) if 0 < step < 16 else bytes([kind]) + _zigzag(number))
        if kind not in (TRUE, FALSE):
            out.append(_written(kind, value))
        last = number
    return b"".join(out) + b"\0"


def _field(fields: Struct, number: int) -> Any:
    return next((v for n, _, v in fields if n == number), None)


def _changed(fields: Struct, change: dict[int, Any]) -> Struct:
    return [(n, k, change[n](v) if n in change else v) for n, k, v in fields]


def _moved(group: Struct, by: int, ordinal: int) -> Struct:
    """A row group whose bytes lie `by` further on.  An offset of 0 says nothing."""
    move = lambda v: v + by if v else v
    meta = lambda m: _changed(m, dict.fromkeys(PAGE_OFFSETS, move))
    chunk = lambda c: _changed(c, {CHUNK_OFFSET: move, CHUNK_META: meta, **dict.fromkeys(CHUNK_INDEXES, move)})
    return _changed(group, {GROUP_COLUMNS: lambda cs: (cs[0], [chunk(c) for c in cs[1]]), GROUP_OFFSET: move, GROUP_ORDINAL: lambda _: ordinal})


def footer(source: Any) -> tuple[Struct, int]:
    """(footer, where it begins) of an open Parquet file."""
    size = source.size()
    tail = source.read_at(8, size - 8)
    if tail[4:] != MAGIC:
        raise ValueError("not a Parquet file")
    (length,) = struct.unpack("<i", tail[:4])
    return _Reader(source.read_at(length, size - 8 - length)).struct(), size - 8 - length


def splice(store: fs.FileSystem, files: Sequence[str], out: BinaryIO, keys: dict[str, str] | None = None) -> int:
    """Writes the files' row groups, in order, as one file with these keys in its footer; returns its rows.

    The files have one schema, as those of one write do; another one is an error.
    """
    out.write(MAGIC)
    at, rows, groups, head = len(MAGIC), 0, [], None
    for name in files:
        with store.open_input_file(name) as source:
            meta, end = footer(source)
            if head is None:
                head = meta
            elif _field(meta, 2) != _field(head, 2):
                raise ValueError(f"{name} has another schema")
            for begin in range(len(MAGIC), end, STEP):
                out.write(source.read_at(min(STEP, end - begin), begin))
        own = [g for g in (_field(meta, GROUPS) or (STRUCT, []))[1] if _field(g, ROWS)]  # empty ones go
        groups += [_moved(g, at - len(MAGIC), len(groups) + k) for k, g in enumerate(own)]
        rows += _field(meta, ROWS)
        at += end - len(MAGIC)
    if head is None:
        raise ValueError("no files to splice")
    pairs = [[(1, BINARY, k.encode()), (2, BINARY, v.encode())] for k, v in (keys or {}).items()]
    fields = [f for f in head if f[0] not in (ROWS, GROUPS, KEYS)] + [(ROWS, I64, rows), (GROUPS, LIST, (STRUCT, groups))] + ([(KEYS, LIST, (STRUCT, pairs))] if pairs else [])
    made = _struct(sorted(fields, key=lambda f: f[0]))
    out.write(made + struct.pack("<i", len(made)) + MAGIC)
    return rows
