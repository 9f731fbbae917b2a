"""What operators share: cuts of lineage in the folder the session names, batches, kinds of ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

from quadrille.sources.shared import shared_dir


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """`df` written to the shared folder as Parquet and read back: a cut that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch between Spark and Python: texts are long, and both sides hold several batches.
BATCH_BYTES = 8 << 20


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES where they are larger; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")  # Spark has a default for it
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def whole_ids(rows: DataFrame) -> bool:
    """Whether doc_id is a whole number of 64 bits or fewer; other ids (text, larger numbers) don't fit a long."""
    return isinstance(rows.schema["doc_id"].dataType, IntegralType)
