"""Tables that a plan reads more than once, written below the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local master may go without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'corpusloom-shared')}"


def delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the folder is scratch
        return


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(delete, spark, path)
    return path


def written(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` as a scan of files that every executor can read: lineage ends there, and a lost executor costs retries only.

    With ``batch_rows`` Python workers get at most so many rows at a time while ``df`` is written; the session's setting comes back after it.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, label)
    was = spark.conf.get(BATCH)
    if batch_rows and not 0 < int(was) <= batch_rows:
        spark.conf.set(BATCH, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, was)
    return spark.read.schema(df.schema).parquet(path)
