"""Generations of source tables: publish with a revision check, membership, census."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleRevision(RuntimeError):
    """Another writer published a newer generation first."""


def membership(prior: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both with ``state``: kept, added, or not_observed."""
    a, b = prior.select(*keys).distinct().withColumn("_a", F.lit(True)), observed.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "not_observed").otherwise("kept").alias("state"))


def same_census(before: DataFrame, after: DataFrame) -> bool:
    """Whether two listings hold the same rows."""
    return before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def retire(sources: DataFrame, missing: DataFrame, still_seen: DataFrame) -> DataFrame:
    """``sources`` after a listing in which ``missing`` (source_id) are gone.

    One that no other root still observes (``still_seen``) becomes unavailable in a new
    revision; its other columns stay. One that is unavailable already stays as it is.
    """
    gone = missing.select("source_id").distinct().join(still_seen.select("source_id").distinct(), "source_id", "left_anti").withColumn("_gone", F.lit(True))
    out = sources.join(gone, "source_id", "left")
    now = F.col("_gone").isNotNull() & (F.col("availability") != "unavailable")
    changed = {"availability": F.when(now, "unavailable").otherwise(F.col("availability")), "revision": F.col("revision") + now.cast("int")}
    return out.withColumns(changed).select(*sources.columns)


class SnapshotTable:
    """Generations of one table. A reader pins the newest published one; earlier ones stay readable.

    A generation is written to a folder of its own and published by a small pointer file
    ``revision=N``, which is created only if there is none. So of two writers one publishes
    and the other gets StaleRevision, a failed write leaves nothing that a reader or a later
    writer meets, and no reader sees half a generation. Works on any store of Spark whose
    create without overwriting is atomic.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _published(self) -> dict[int, str]:
        """Folder of each published revision. A pointer that is still empty is not published."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return {}
        numbers = [int(n[9:]) for n in (s.getPath().getName() for s in fs.listStatus(p) if s.isFile() and s.getLen() > 0) if n.startswith("revision=")]
        return {n: self._pointer(n) for n in numbers}

    def _pointer(self, revision: int) -> str:
        fs, p = self._fs(f"{self.path}/revision={revision}")
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def revision(self) -> int:
        """Newest published revision; 0 if there is none."""
        return max(self._published(), default=0)

    def replace(self, rows: DataFrame, expected: int) -> int:
        """Publishes the next revision, if ``expected`` still is the newest one when the rows are written."""
        from py4j.protocol import Py4JJavaError

        if self.revision() != expected:
            raise StaleRevision(f"expected {expected}, found {self.revision()}")
        folder = f"generation-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{self.path}/{folder}")
        fs, pointer = self._fs(f"{self.path}/revision={expected + 1}")
        try:
            stream = fs.create(pointer, False)
        except Py4JJavaError as taken:
            fs.delete(self._fs(f"{self.path}/{folder}")[1], True)
            raise StaleRevision(f"revision {expected + 1} was published by another writer") from taken
        stream.write(bytearray(folder.encode()))
        stream.close()
        return expected + 1

    def read(self, revision: int | None = None) -> DataFrame:
        published = self._published()
        at = max(published, default=0) if revision is None else revision
        if at not in published:
            raise FileNotFoundError(f"{self.path}: revision {at}")
        return self.spark.read.parquet(f"{self.path}/{published[at]}")
