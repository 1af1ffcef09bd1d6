"""Intermediate tables in the session's shared folder: lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it isn't set, a folder of this machine if the session is local (tests), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='atlas-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Whether a query's shuffle files are deleted when it ends; otherwise when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For plans that sort and join many short strings: these shrink to a twentieth in a shuffle or a file, so that a task that
#: takes the usual 64 MB or 128 MB of them holds over a GB. Smaller settings of the session stay.
SMALL_TASKS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "16m"}


def written(df: DataFrame, name: str, small_tasks: bool = False) -> DataFrame:
    """df written to the shared folder and read back. What was shuffled for it is deleted at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    small = {k: v for k, v in SMALL_TASKS.items() if small_tasks and size(v) < size(spark.conf.get(k))}
    held = {CLEANUP: "true"} | small
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df.select("*").write.parquet(path)  # a plan of its own, made while the settings hold
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
