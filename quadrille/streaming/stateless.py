"""The stateless operators over file streams: new files of a lake are extracted as they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quadrille.functions.geometry import Geometry
from quadrille.operators.extract import extract
from quadrille.plans.predicate import Predicate


def feature_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def extract_stream(stream: DataFrame, target: str, checkpoint: str, region: Geometry | None = None, where: Predicate | None = None, columns: Sequence[str] | None = None) -> StreamingQuery:
    """Appends the extract of what has come to a Parquet folder, exactly once, and ends when all is read."""
    return extract(stream, region, where, columns).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
