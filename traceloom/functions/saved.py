"""Working tables in the folder that all executors share.

A frame that several later steps read, each of which joins it with itself, would be
planned and computed once for each of them. Written and read again it is computed once,
survives lost executors and ends the plan there.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str = "work") -> str:
    """A new folder below the one that executors share; it goes when the session ends. Only a local session may have none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="traceloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, folder)
    return folder


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already
        pass


def saved(rows: DataFrame) -> DataFrame:
    """The same rows, read from a table that they were written to."""
    path = work_folder(rows.sparkSession, "table")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
