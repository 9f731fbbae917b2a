"""Row groups as units of work: functions over single row groups, run where the executors are."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quadrille.functions.geometry import Geometry
from quadrille.plans.predicate import Predicate
from quadrille.sources.grouped import grouped_extract, opened
from quadrille.sources.index import row_group_counts

#: (file, row group, its table) to a table.
OnTable = Callable[[str, int, pa.Table], pa.Table]


def _opened(name: str):
    import pyarrow.parquet as pq

    store, path = opened(name)
    return pq.ParquetFile(store.open_input_file(path))


def map_row_groups(spark: SparkSession, units: Sequence[tuple[str, int]], function: OnTable, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """What `function` makes of each (file, row group), a task for each; failed tasks are tried again by Spark."""
    rows = spark.createDataFrame(spark.sparkContext.parallelize(list(units), max(1, min(len(units), 10_000))), "filename string, row_group int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                with _opened(unit["filename"]) as f:
                    table = f.read_row_group(unit["row_group"], columns=None if columns is None else list(columns))
                yield from function(unit["filename"], unit["row_group"], table.replace_schema_metadata(None)).to_batches(10_000)

    return rows.mapInArrow(run, schema)


def map_parquet_dataset(spark: SparkSession, files: Sequence[str], function: OnTable, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """map_row_groups over all row groups of the files."""
    counts = row_group_counts(spark, list(files)).collect()  # one row for each file
    return map_row_groups(spark, [(r.filename, g) for r in counts for g in range(r.row_groups)], function, schema, columns)


def row_group_scan(spark: SparkSession, filename: str, row_group: int, region: Geometry | None = None, where: Predicate | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The extract of one row group: its columns and rows alone are read."""
    return grouped_extract(spark.read.parquet(filename), [(filename, row_group)], region, where, columns)
