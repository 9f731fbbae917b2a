"""Result files named by what they hold."""

from __future__ import annotations

import hashlib
import shutil
from collections.abc import Sequence
from pathlib import Path
from typing import Any

import pyarrow.compute as pc
from pyspark.sql import Column

from quadrille.functions.geometry import Geometry


def short(value: Any) -> str:
    return hashlib.sha256(str(value).encode()).hexdigest()[:8]


def _filter(where: Any) -> str:
    if where is None:
        return "nofilter"
    if isinstance(where, pc.Expression):  # its text leaves out the middle of long lists
        return hashlib.sha256(where.__reduce__()[1][0]).hexdigest()[:8]
    return short(where._jc.toString() if isinstance(where, Column) and hasattr(where, "_jc") else where)


def extract_name(release: str, theme: str, type_: str, region: Geometry, where: Any = None, columns: Sequence[str] | None = None, sort: bool = True, output: Sequence[Any] = ()) -> Path:
    """release/theme=T/type=U/{region}_{filter}[_{columns}][_{output}][_sorted].parquet; `output` are writer settings that differ from the defaults."""
    parts = [region.digest(), _filter(where)]
    if columns is not None:
        parts.append(short(sorted(columns)))
    if output:
        parts.append(short(list(output)))
    return Path(release) / f"theme={theme}" / f"type={type_}" / ("_".join(parts) + ("_sorted" if sort else "") + ".parquet")


def wide_name(release: str, pairs: Sequence[tuple[str, str]], region: Geometry, filters: Sequence[Any] | None, depths: Sequence[int | None], options: dict, pruned: bool, sort: bool) -> Path:
    """As extract_name, for wide forms; the order of pairs does not matter."""
    order = sorted(range(len(pairs)), key=lambda i: pairs[i])
    where = Path(f"theme={pairs[0][0]}") / f"type={pairs[0][1]}" if len(pairs) == 1 else Path(short(sorted(pairs)))
    own = [filters[i] for i in order] if filters and any(f is not None for f in filters) else None
    depth = [depths[i] for i in order]
    named = "" if all(d is None for d in depth) else "_h" + "-".join("n" if d is None else str(d) for d in ([depth[0]] if len(set(depth)) == 1 else depth))
    return Path(release) / where / f"{region.digest()}_{_filter(None if own is None else [_filter(f) for f in own])}_{short(sorted(options.items()))}_wide_form{named}{'_pruned' if pruned else ''}{'_sorted' if sort else ''}.parquet"


def clear(folder: str | Path) -> None:
    """Removes a cache folder, if it is there."""
    shutil.rmtree(folder, ignore_errors=True)
