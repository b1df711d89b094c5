"""Runs, chains and windows over ordered events, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.operators.blocks import WIDTH, running


def recovery_chains(rows: DataFrame, keys: list[str], failed: Column, success: Column, order: str = "id", width: int = WIDTH) -> DataFrame:
    """A chain is a run of failures up to the success that closes it: keys, chain, failures, resolved, elapsed_ms, failed intervals.

    ``elapsed_ms`` is from the end of the first failure to the end of the success; null if none came.
    """
    marked = rows.withColumn("_f", failed).withColumn("_s", success).where("_f or _s").select(*dict.fromkeys([*keys, order, "end_ms", "_f", "_s"]))
    placed = running(marked, keys, order, width, sums={"chain": F.col("_s").cast("long")}, inclusive=False)
    out = placed.groupBy(*keys, "chain").agg(
        F.count_if("_f").alias("failures"), F.bool_or("_s").alias("resolved"), F.min(F.when(F.col("_f"), F.col("end_ms"))).alias("_first"), F.max(F.when(F.col("_s"), F.col("end_ms"))).alias("_done"),
    ).where("failures > 0")
    return out.withColumn("elapsed_ms", F.when(F.col("resolved"), F.col("_done") - F.col("_first"))).drop("_first", "_done")


def episodes(rows: DataFrame, keys: list[str], least: int, window_ms: int, at: str = "end_ms", tie: str = "id") -> DataFrame:
    """Merged trailing windows with at least ``least`` members: keys, first_ms, last_ms, members.

    A member's window holds members whose instant is at most ``window_ms`` before its own
    and that do not come after it; windows that share a member are one episode.
    """
    order = W.partitionBy(*keys).orderBy(at, tie)
    older = W.partitionBy(*keys).orderBy(at).rangeBetween(W.unboundedPreceding, -(window_ms + 1))
    ranked = rows.withColumn("_r", F.row_number().over(order) - 1).withColumn("_l", F.count(F.lit(1)).over(older))
    # The first instant in each window goes with it, so that an episode needs no join back.
    first = F.min(at).over(W.partitionBy(*keys).orderBy(at).rangeBetween(-window_ms, W.currentRow))
    full = ranked.withColumn("_first", first).where(F.col("_r") - F.col("_l") + 1 >= least)
    new = F.when(F.col("_l") > F.lag("_r").over(order), 1).otherwise(0)
    numbered = full.withColumn("_new", new).withColumn("_e", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_e").agg(F.min("_first").alias("first_ms"), F.max(at).alias("last_ms"), (F.max("_r") - F.min("_l") + 1).alias("members")).drop("_e")


def runs(rows: DataFrame, keys: list[str], same: list[str], order: str = "id", width: int = WIDTH) -> DataFrame:
    """Adds ``run``: consecutive rows of a partition whose ``same`` columns are equal share a number."""
    met = running(rows.withColumn("_same", F.struct(*same)), keys, order, width, previous={"_before": "_same"})
    # A struct of columns is null only where there is no row before.
    return running(met, keys, order, width, sums={"run": (F.col("_before").isNull() | (F.col("_before") != F.col("_same"))).cast("long")}).drop("_same", "_before")


def window_search(rows: DataFrame, keys: list[str], lookup: Column, key: str, barrier: Column, window_ms: int, least: int, least_same: int, most_barriers: int) -> DataFrame:
    """The first closed window, ending at a lookup, that is crowded with lookups: keys, last_ms, lookups, most_same.

    Lookups count by their end. Rows of ``barrier`` count if their closed interval meets
    the window. Both sides are cut into buckets of the window's length, so that the range
    join is an equi-join on the bucket and touches two buckets for each instant.
    """
    looks = rows.where(lookup).select(*keys, F.col(key).alias("_k"), "end_ms").withColumn("_b", F.floor(F.col("end_ms") / F.lit(float(window_ms))).cast("long"))
    instants = looks.select(*keys, F.col("end_ms").alias("last_ms")).distinct().withColumn("_b", F.explode(F.array(F.floor(F.col("last_ms") / F.lit(float(window_ms))).cast("long"), (F.floor(F.col("last_ms") / F.lit(float(window_ms))) - 1).cast("long"))))
    near = instants.join(looks, [*keys, "_b"]).where(F.col("end_ms").between(F.col("last_ms") - window_ms, F.col("last_ms")))
    counts = near.groupBy(*keys, "last_ms", "_k").count().groupBy(*keys, "last_ms").agg(F.sum("count").alias("lookups"), F.max("count").alias("most_same"))
    crowded = counts.where((F.col("lookups") >= least) & (F.col("most_same") >= least_same))
    low, high = F.floor(F.col("start_ms") / F.lit(float(window_ms))).cast("long"), F.floor(F.col("end_ms") / F.lit(float(window_ms))).cast("long")
    walls = rows.where(barrier).select(*keys, "id", "start_ms", "end_ms").withColumn("_b", F.explode(F.sequence(low, high)))
    probe = crowded.withColumn("_b", F.explode(F.sequence(F.floor((F.col("last_ms") - window_ms) / F.lit(float(window_ms))).cast("long"), F.floor(F.col("last_ms") / F.lit(float(window_ms))).cast("long"))))
    met = probe.join(walls, [*keys, "_b"]).where((F.col("start_ms") <= F.col("last_ms")) & (F.col("end_ms") >= F.col("last_ms") - window_ms)).select(*keys, "last_ms", "id").distinct()
    met = met.groupBy(*keys, "last_ms").agg(F.count(F.lit(1)).alias("barriers"))
    clear = crowded.join(met, [*keys, "last_ms"], "left").where(F.coalesce("barriers", F.lit(0)) <= most_barriers)
    return clear.groupBy(*keys).agg(F.min(F.struct("last_ms", "lookups", "most_same")).alias("w")).select(*keys, "w.last_ms", "w.lookups", "w.most_same")
