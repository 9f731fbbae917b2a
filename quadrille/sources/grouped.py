"""Row groups as a data source: the groups that an index keeps, a partition for each, read through Arrow's scanner.

    spark.read.format("row_groups").schema(...).option("units", units_option(...)).load()

The schema names the columns that are read.  Tests that Arrow makes as Spark
does go into the scanner, where a group's statistics can end its reading; what
differs is left to Spark.  With the option `trace`, a folder of the shared
store, each partition tells there what it read.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from quadrille.functions.geometry import Geometry
from quadrille.operators.extract import BBOX, GEOMETRY, extract
from quadrille.plans.predicate import Predicate, compiled

#: Rows of one Arrow batch.
ROWS = 10_000


@dataclass(frozen=True)
class Unit(ds.InputPartition):
    file: str
    group: int


def opened(name: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path there."""
    return fs.FileSystem.from_uri(name) if ":" in name.split("/")[0] else (fs.LocalFileSystem(), name)


def units_option(units: Iterable[tuple[str, int]]) -> str:
    """(file, row group) pairs as the source's option, files once each."""
    by_file: dict[str, list[int]] = {}
    for file, group in units:
        by_file.setdefault(file, []).append(group)
    return json.dumps({f: sorted(set(g)) for f, g in sorted(by_file.items())})


_ORDERED: dict[type, Callable] = {ds.LessThan: lambda c, v: c < v, ds.LessThanOrEqual: lambda c, v: c <= v, ds.GreaterThan: lambda c, v: c > v, ds.GreaterThanOrEqual: lambda c, v: c >= v}
_TEXT: dict[type, Callable] = {ds.StringStartsWith: pc.starts_with, ds.StringEndsWith: pc.ends_with, ds.StringContains: pc.match_substring}


def _plain(value: object) -> bool:
    """Values that mean the same on both sides."""
    return isinstance(value, (bool, int, str)) or isinstance(value, float) and not math.isnan(value)


def arrow_test(test: ds.Filter, kind_of: Callable[[tuple[str, ...]], T.DataType | None]) -> pc.Expression | None:
    """A pushed test as Arrow's expression with Spark's meaning of null and NaN; None if there is none."""
    if isinstance(test, ds.Not):
        with_null = isinstance(test.child, ds.In) and None in test.child.value
        inner = None if with_null or isinstance(test.child, (ds.EqualNullSafe, ds.Not)) else arrow_test(test.child, kind_of)
        return None if inner is None else ~inner
    kind = kind_of(test.attribute)
    if kind is None:
        return None
    column = pc.field(*test.attribute)
    if isinstance(test, ds.IsNull):
        return column.is_null()
    if isinstance(test, ds.IsNotNull):
        return column.is_valid()
    if isinstance(test, ds.In):
        values = [v for v in test.value if v is not None]
        return pc.if_else(column.is_valid(), column.isin(values), pa.scalar(None, pa.bool_())) if values and all(map(_plain, values)) else None
    if isinstance(test, ds.EqualNullSafe):
        return column.is_null() if test.value is None else column == test.value if _plain(test.value) else None
    if not _plain(test.value):
        return None
    if isinstance(test, ds.EqualTo):
        return column == test.value
    if (order := _ORDERED.get(type(test))) is not None:
        # Spark has NaN above all numbers.
        greatest = isinstance(kind, (T.FloatType, T.DoubleType)) and isinstance(test, (ds.GreaterThan, ds.GreaterThanOrEqual))
        return order(column, test.value) | pc.is_nan(column) if greatest else order(column, test.value)
    return _TEXT[type(test)](column, test.value) if type(test) in _TEXT else None


class RowGroupReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.trace = schema, options.get("trace")
        self.units = [Unit(f, g) for f, groups in json.loads(options["units"]).items() for g in groups]
        self.tests: list[ds.Filter] = []

    def _kind(self, path: tuple[str, ...]) -> T.DataType | None:
        kind: T.DataType = self.schema
        for part in path:
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            kind = kind[part].dataType
        return kind

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for test in filters:
            if arrow_test(test, self._kind) is None:
                yield test
            else:
                self.tests.append(test)

    def partitions(self) -> Sequence[ds.InputPartition]:
        return list(self.units)

    def read(self, partition: Unit | None) -> Iterator[pa.RecordBatch]:
        from pyarrow.dataset import ParquetFileFormat
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # no row group at all
            return
        store, path = opened(partition.file)
        group = ParquetFileFormat().make_fragment(path, store).subset(row_group_ids=[partition.group])
        test = None
        for part in self.tests:
            own = arrow_test(part, self._kind)
            test = own if test is None else test & own
        wanted, n = to_arrow_schema(self.schema), 0
        for batch in group.scanner(columns=wanted.names, filter=test, batch_size=ROWS, use_threads=False).to_batches():
            n += batch.num_rows
            if batch.num_rows:
                yield from pa.Table.from_batches([batch]).cast(wanted).to_batches()
        if self.trace:
            store, folder = opened(self.trace)
            with store.open_output_stream(f"{folder}/{uuid.uuid4().hex}.json") as out:
                out.write(json.dumps({"file": partition.file, "row_group": partition.group, "columns": wanted.names, "tests": len(self.tests), "rows": n}).encode())


class RowGroupSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> T.StructType:
        raise ValueError("row_groups needs a schema: it names the columns to read")

    def reader(self, schema: T.StructType) -> RowGroupReader:
        return RowGroupReader(schema, self.options)


def referred(df: DataFrame, test: Column) -> set[str]:
    """The top columns that a test names."""
    own = df.where(test)._jdf.queryExecution().analyzed().references().toSeq()
    return {own.apply(i).name() for i in range(own.size())}


def grouped_extract(whole: DataFrame, units: Sequence[tuple[str, int]], region: Geometry | None = None, where: Predicate | None = None, columns: Sequence[str] | None = None, trace: str | None = None, exact: bool | None = None) -> DataFrame:
    """The extract of `whole`, a table's plain scan, from these (file, row group) units alone and of the columns that it needs."""
    spark: SparkSession = whole.sparkSession
    plain = extract(whole, region, where, columns, exact)
    if not units:
        return plain.limit(0)
    test = compiled(where, whole.schema)
    names = {*plain.columns, *(referred(whole, test) if test is not None else ()), *((BBOX, *((GEOMETRY,) if (not region.is_rectangle if exact is None else exact) else ())) if region is not None else ())}
    schema = T.StructType([f for f in whole.schema.fields if f.name in names])
    spark.dataSource.register(RowGroupSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # it concerns Python sources alone
    read = spark.read.format("row_groups").schema(schema).option("units", units_option(units))
    kept = extract((read if trace is None else read.option("trace", trace)).load(), region, test, None, exact)
    return kept.select(*[f"`{c}`" for c in plain.columns])
