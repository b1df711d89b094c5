"""Working tables in the folder that all executors share, and small session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="traceloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Parquet tables that cut lineage. They survive lost executors and go when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/traceloom-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the session may be gone already
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table``, whose keys are unique and not null, without ``weight``.

    ``weight`` is how many of the ``total`` rows have the key. Keys of more than a thousandth
    of them are fewer than a thousand, whatever the size: their part of the table is broadcast
    and their rows stay where they are, so that no key fills a task. The rest is shuffled.
    """
    limit = total // 1000
    heavy, light = (table.where(x).drop(weight) for x in (F.col(weight) > limit, F.col(weight) <= limit))
    met = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, "left")
    return met.unionByName(rest)
