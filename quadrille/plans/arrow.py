"""Arrow expressions as Columns, with Arrow's rules of null and NaN.

Arrow writes an expression as a record batch: its schema's metadata list the
parts in order of reading (`call` ... `end`, `field_ref`, `literal`), the one
row holds literals and options.  The list repeats keys, so it is read through
the C data interface, which keeps them all.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Schema(ctypes.Structure):
    """The head of the C data interface's schema."""

    _fields_ = [("format", ctypes.c_char_p), ("name", ctypes.c_char_p), ("metadata", ctypes.c_void_p)]


def _metadata(schema: pa.Schema) -> list[tuple[str, str]]:
    """All keys and values, in order: a number of pairs, then lengths and bytes, in native order."""
    capsule = schema.__arrow_c_schema__()
    pointer = ctypes.pythonapi.PyCapsule_GetPointer
    pointer.restype, pointer.argtypes = ctypes.c_void_p, [ctypes.py_object, ctypes.c_char_p]
    at = _Schema.from_address(pointer(capsule, b"arrow_schema")).metadata
    if not at:
        return []

    def number() -> int:
        nonlocal at
        (n,) = struct.unpack("=i", ctypes.string_at(at, 4))
        at += 4
        return n

    def text() -> str:
        nonlocal at
        n = number()
        raw = ctypes.string_at(at, n)
        at += n
        return raw.decode()

    return [(text(), text()) for _ in range(number())]


@dataclass(frozen=True)
class Part:
    """A column, its type where it is known, and what it means as a literal."""

    column: Column
    kind: T.DataType | None
    value: Any = None

    @property
    def floating(self) -> bool:
        return isinstance(self.kind, (T.FloatType, T.DoubleType))


_TRUTH = T.BooleanType()
_COMPARED: dict[str, Callable[[Column, Column], Column]] = {
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "less": lambda a, b: a < b,
    "less_equal": lambda a, b: a <= b,
    "greater": lambda a, b: a > b,
    "greater_equal": lambda a, b: a >= b,
}
_COUNTED: dict[str, Callable[[Column, Column], Column]] = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b}
_PATTERNS: dict[str, Callable[[Column, Column], Column]] = {"starts_with": F.startswith, "ends_with": F.endswith, "match_substring": F.contains}
_TEXTS: dict[str, Callable[[Column], Column]] = {"utf8_lower": F.lower, "utf8_upper": F.upper, "utf8_length": lambda c: F.char_length(c)}


def _compared(name: str, a: Part, b: Part) -> Column:
    """No order and no equality holds for NaN; null stays null."""
    made = _COMPARED[name](a.column, b.column)
    odd = [F.isnan(p.column) for p in (a, b) if p.floating]
    if not odd:
        return made
    return F.when(a.column.isNull() | b.column.isNull(), F.lit(None).cast("boolean")).when(reduce(Column.__or__, odd), F.lit(name == "not_equal")).otherwise(made)


def _is_in(value: Part, options: dict) -> Column:
    known = [v for v in options["value_set"] if v is not None]
    with_null = len(known) < len(options["value_set"])
    found = value.column.isin(known) if known else F.when(value.column.isNotNull(), F.lit(False))
    matching = ("match", "skip", "emit_null", "inconclusive")[options["null_matching_behavior"]]
    if matching in ("match", "skip"):
        out = F.coalesce(found, F.lit(False))
        return out | value.column.isNull() if with_null and matching == "match" else out
    if matching == "inconclusive" and with_null:
        return F.when(found, F.lit(True))
    return found


def _pattern(name: str, value: Part, options: dict) -> Column:
    column, wanted = value.column, options["pattern"]
    wanted = wanted.decode() if isinstance(wanted, bytes) else wanted
    return _PATTERNS[name](F.lower(column), F.lit(wanted.lower())) if options["ignore_case"] else _PATTERNS[name](column, F.lit(wanted))


class _Reader:
    def __init__(self, expression: pc.Expression, schema: T.StructType | None) -> None:
        batch = pa.ipc.open_file(expression.__reduce__()[1][0]).get_batch(0)
        self.parts, self.batch, self.schema, self.at = _metadata(batch.schema), batch, schema, 0

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.parts[self.at - 1]

    def read(self) -> Part:
        key, value = self.next()
        if key == "literal":
            scalar = self.batch.column(int(value))[0]
            return self._literal(scalar.as_py(), scalar.type)
        if key == "field_ref":
            return self._field([value])
        if key == "nested_field_ref":
            return self._field([self.next()[1] for _ in range(int(value))])
        if key != "call":
            raise ValueError(f"unknown part of an Arrow expression: {key}")
        arguments, options = [], {}
        while self.parts[self.at][0] != "end":
            if self.parts[self.at][0] == "options":
                at = int(self.next()[1])
                options, self.types = self.batch.column(at)[0].as_py(), self.batch.schema.field(at).type
            else:
                arguments.append(self.read())
        self.next()
        return self._call(value, arguments, options)

    @staticmethod
    def _literal(value: Any, kind: pa.DataType) -> Part:
        from pyspark.sql.pandas.types import from_arrow_type

        own = T.NullType() if pa.types.is_null(kind) else from_arrow_type(kind)
        return Part(F.lit(value) if isinstance(own, T.NullType) else F.lit(value).cast(own), own, value)

    def _field(self, path: list[str]) -> Part:
        kind: T.DataType | None = self.schema
        for name in path:
            if isinstance(kind, T.StructType) and name not in kind.names:
                raise ValueError(f"no field {'.'.join(path)}")
            kind = kind[name].dataType if isinstance(kind, T.StructType) else None
        return Part(F.col(".".join(f"`{p}`" for p in path)), kind)

    def _call(self, name: str, parts: list[Part], options: dict) -> Part:
        columns = [p.column for p in parts]
        plain = name.removesuffix("_checked")
        if name in _COMPARED:
            return Part(_compared(name, *parts), _TRUTH)
        if name in ("and_kleene", "or_kleene"):
            return Part(columns[0] & columns[1] if name == "and_kleene" else columns[0] | columns[1], _TRUTH)
        if name in ("and", "or"):  # null where either side is
            both = columns[0] & columns[1] if name == "and" else columns[0] | columns[1]
            return Part(F.when(columns[0].isNotNull() & columns[1].isNotNull(), both), _TRUTH)
        if name == "invert":
            return Part(~columns[0], _TRUTH)
        if name == "is_null":
            nan = F.coalesce(F.isnan(columns[0]), F.lit(False)) if options.get("nan_is_null") and parts[0].floating else F.lit(False)
            return Part(columns[0].isNull() | nan, _TRUTH)
        if name == "is_valid":
            return Part(columns[0].isNotNull(), _TRUTH)
        if name == "is_nan":
            return Part(F.when(columns[0].isNotNull(), F.isnan(columns[0]) if parts[0].floating else F.lit(False)), _TRUTH)
        if name == "is_in":
            return Part(_is_in(parts[0], options), _TRUTH)
        if name in _PATTERNS:
            return Part(_pattern(name, parts[0], options), _TRUTH)
        if plain in _COUNTED:
            kinds = [p.kind for p in parts]
            floating = next((k for k in kinds if isinstance(k, T.DoubleType)), next((k for k in kinds if isinstance(k, T.FloatType)), None))
            return Part(_COUNTED[plain](*columns), floating or T.LongType())
        if plain == "negate":
            return Part(-columns[0], parts[0].kind)
        if name in _TEXTS:
            return Part(_TEXTS[name](columns[0]), T.IntegerType() if name == "utf8_length" else T.StringType())
        if name == "if_else":
            test, yes, no = columns
            return Part(F.when(test, yes).when(~test, no), parts[1].kind)
        if name == "coalesce":
            return Part(F.coalesce(*columns), parts[0].kind)
        if name == "cast":
            from pyspark.sql.pandas.types import from_arrow_type

            kind = from_arrow_type(self.types.field("to_type").type)
            return Part(columns[0].cast(kind), kind)
        raise ValueError(f"Arrow's function {name} has no counterpart here")


def from_arrow(expression: pc.Expression, schema: T.StructType | None = None) -> Column:
    """The expression over columns of `schema`, which tells where NaN can be."""
    return _Reader(expression, schema).read().column
