"""Where intermediate tables go, and how large a broadcast and an Arrow batch may be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkatlas.plans.tables import dropped, written

__all__ = ["bounded_batches", "dropped", "hinted", "is_small", "written"]

#: The most bytes that an operator broadcasts; larger sides are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: What a row of a broadcast table takes besides its values: its header, and its place in the hash table.
ROW_BYTES = 80
#: The most rows of an Arrow batch: texts may be long, and both the JVM and the Python worker hold a batch or two.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's limit of rows in an Arrow batch to BATCH_ROWS, if it is higher or none."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def is_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df (a written table) can be broadcast: its counted rows, of row_bytes of values each, are within limit."""
    return df.count() * (row_bytes + ROW_BYTES) <= limit


def hinted(df: DataFrame, row_bytes: int) -> DataFrame:
    """df (a written table) to be broadcast if it is small; else a join with it shuffles."""
    return F.broadcast(df) if is_small(df, row_bytes) else df
