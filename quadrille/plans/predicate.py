"""Attribute predicates: disjunctive normal form, SQL text, an Arrow expression or a Column, compiled to a Column.

Null and NaN follow Arrow's filters: a row whose test is null is dropped, but
`not in` keeps null, `in` with None matches null, and no ordering holds for NaN.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.errors import BadParameter
from quadrille.plans.arrow import from_arrow

Condition = tuple
Predicate = Column | str | Sequence | pc.Expression


def field(name: str | Sequence[str]) -> Column:
    """A column by name; a sequence, or dots in a name, go into structs."""
    parts = name.split(".") if isinstance(name, str) else list(name)
    return F.col(".".join(f"`{p}`" for p in parts))


def _kind(name: str | Sequence[str], schema: T.StructType | None) -> T.DataType | None:
    kind: T.DataType | None = schema
    for part in name.split(".") if isinstance(name, str) else name:
        kind = kind[part].dataType if isinstance(kind, T.StructType) and part in kind.names else None
    return kind


def condition(test: Condition, schema: T.StructType | None = None) -> Column:
    """(name, operator, value) as a Column."""
    name, operator, value = test
    c = field(name)
    if operator in ("in", "not in"):
        values = list(value)
        found = c.isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
        if None in values:
            found = F.coalesce(found, F.lit(False)) | c.isNull()
        return found if operator == "in" else ~F.coalesce(found, F.lit(False))
    simple = {"=": lambda: c == value, "==": lambda: c == value, "!=": lambda: c != value, "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value}
    if operator not in simple:
        raise ValueError(f"unknown operator {operator!r}")
    made = simple[operator]()
    floating = isinstance(_kind(name, schema), (T.FloatType, T.DoubleType))
    return made & ~F.isnan(c) if floating and operator in (">", ">=") else made


def compiled(predicate: Predicate | None, schema: T.StructType | None = None) -> Column | None:
    """The predicate as a Column; None stays None."""
    if predicate is None or isinstance(predicate, Column):
        return predicate
    if isinstance(predicate, str):
        return F.expr(predicate)
    if isinstance(predicate, pc.Expression):
        return from_arrow(predicate, schema)
    groups = [predicate] if predicate and _is_condition(predicate[0]) else list(predicate)
    if not groups or any(not g for g in groups):
        raise ValueError("Malformed filters")
    return reduce(or_, (reduce(and_, (condition(t, schema) for t in g)) for g in groups))


def _is_condition(x: Any) -> bool:
    """A test, not a list of tests: three parts of which the second is an operator's name."""
    return isinstance(x, tuple) and len(x) == 3 and isinstance(x[1], str)


def parsed(text: str) -> Condition:
    """`column operator value` as a test; digits with at most one dot are a number, all else is text."""
    parts = text.split()
    if len(parts) != 3:
        raise BadParameter(f"Cannot parse filter {text!r}: column, operator and value expected")
    name, operator, value = parts
    if operator not in ("=", "==", "!=", "<", "<=", ">", ">="):
        raise BadParameter(f"Cannot parse filter {text!r}: unknown operator {operator}")
    if "," in name:
        warnings.warn("Commas between nested names are deprecated; use dots", DeprecationWarning, stacklevel=2)
        name = name.replace(",", ".")
    number = re.fullmatch(r"\d+\.?\d*|\.\d+", value)
    return name, operator, float(value) if number else value


def parsed_all(texts: Iterable[str]) -> list[Condition] | None:
    """All given filters, to hold together."""
    return [parsed(t) for t in texts] or None
