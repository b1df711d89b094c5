"""Which sources a root held, over its revisions, as intervals; and what maintenance does to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEYS = ["root", "source_id"]


def intervals(censuses: DataFrame, seen: DataFrame) -> DataFrame:
    """root, source_id, from_revision, to_revision (null: still there) from successive listings.

    censuses: root, revision of the complete listings; seen: root, source_id, revision. Only
    a complete listing says that a source is gone: what an incomplete one saw is not looked at. Sources that come back have several intervals.
    """
    by_root = W.partitionBy("root").orderBy("revision")
    numbered = censuses.select("root", "revision").distinct().withColumns({"_n": F.row_number().over(by_root), "_next": F.lead("revision").over(by_root)})
    rows = seen.select("root", "source_id", "revision").distinct().join(numbered, ["root", "revision"])
    stretch = F.col("_n") - F.row_number().over(W.partitionBy(*KEYS).orderBy("_n"))
    runs = rows.withColumn("_stretch", stretch).groupBy(*KEYS, "_stretch")
    return runs.agg(F.min("revision").alias("from_revision"), F.max(F.struct("_n", "_next"))["_next"].alias("to_revision")).drop("_stretch")


def as_of(held: DataFrame, revision: int) -> DataFrame:
    """Members of each root at a revision."""
    return held.where((F.col("from_revision") <= revision) & (F.col("to_revision").isNull() | (F.col("to_revision") > revision))).select(*KEYS)


def _open(at: Column) -> Column:
    return (F.col("from_revision") < at) & (F.col("to_revision").isNull() | (F.col("to_revision") > at))


def reset(held: DataFrame, roots: DataFrame, censuses: DataFrame) -> DataFrame:
    """Roots (root, revision) that forget all their members: what is open then closes, and opens anew with the next complete listing (root, revision) that still has it."""
    at = roots.select("root", F.col("revision").alias("_at"))
    again = censuses.join(at, "root").where(F.col("revision") >= F.col("_at")).groupBy("root", "_at").agg(F.min("revision").alias("_next"))
    met = held.join(at.join(again, ["root", "_at"], "left"), "root", "left")
    cut = F.coalesce(_open(F.col("_at")), F.lit(False))
    closed = met.withColumn("to_revision", F.when(cut, F.col("_at")).otherwise(F.col("to_revision"))).select(*KEYS, "from_revision", "to_revision")
    back = met.where(cut & (F.col("to_revision").isNull() | (F.col("_next") < F.col("to_revision"))) & F.col("_next").isNotNull())
    return closed.unionByName(back.select(*KEYS, F.col("_next").alias("from_revision"), "to_revision"))


def prune(held: DataFrame, roots: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Roots (root, revision) that forget members which they no longer observe and whose source is unavailable (source_id)."""
    at = roots.select("root", F.col("revision").alias("_at"))
    gone = unavailable.select("source_id").distinct().withColumn("_gone", F.lit(True))
    out = held.join(at, "root", "left").join(gone, "source_id", "left")
    forgotten = F.coalesce(F.col("to_revision") <= F.col("_at"), F.lit(False)) & F.col("_gone").isNotNull()
    return out.where(~forgotten).select(*KEYS, "from_revision", "to_revision")


def rebind(held: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (root, to_root, revision): what is open in the root then closes and goes on in the other."""
    at = moves.select("root", "to_root", F.col("revision").alias("_at"))
    met = held.join(at, "root", "left")
    moved = F.coalesce(_open(F.col("_at")), F.lit(False))
    stays = met.withColumn("to_revision", F.when(moved, F.col("_at")).otherwise(F.col("to_revision"))).select(*KEYS, "from_revision", "to_revision")
    return stays.unionByName(met.where(moved).select(F.col("to_root").alias("root"), "source_id", F.col("_at").alias("from_revision"), "to_revision"))


def retirement(held: DataFrame, sources: DataFrame, root: object, revision: int) -> DataFrame:
    """What a root's members that it has lost become: status, reason, blocking_roots, revision_after.

    sources: source_id, revision, availability. A member that another root still holds, that isn't stored or that has
    changed since it was last observed (``last_revision`` of sources, if given) is retained.
    """
    now = as_of(held, revision)
    mine = held.where(F.col("root") == F.lit(root)).select("source_id").distinct().join(now.where(F.col("root") == F.lit(root)).select("source_id"), "source_id", "left_anti")
    others = now.where(F.col("root") != F.lit(root)).groupBy("source_id").agg(F.count(F.lit(1)).alias("blocking_roots"))
    met = mine.join(others, "source_id", "left").join(sources.withColumn("_stored", F.lit(True)), "source_id", "left").withColumn("blocking_roots", F.coalesce("blocking_roots", F.lit(0)).cast("long"))
    changed = F.col("revision") != F.col("last_revision")
    reason = F.when(F.col("blocking_roots") > 0, "other_root_observed").when(F.col("_stored").isNull(), "not_stored").when(F.col("availability") == "unavailable", None).when(changed, "source_changed")
    status = F.when(reason.isNotNull(), "retained").when(F.col("availability") == "unavailable", "already_unavailable").otherwise("marked_unavailable")
    return met.select("source_id", status.alias("status"), reason.alias("reason"), "blocking_roots", (F.col("revision") + (status == "marked_unavailable").cast("int")).cast("long").alias("revision_after"))
