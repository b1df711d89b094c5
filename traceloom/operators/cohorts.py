"""Grouped measures with coverage: cohorts, mixes, exclusions, deduplication, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.functions.expr import complete_sum, fraction

FEW = 20


def nearest_rank(value: str, q: float) -> Column:
    """The observed sample at rank ceil(q * n); null of an empty group."""
    return F.expr(f"cast(percentile_disc({q}) within group (order by {value}) as bigint)")


def duration_cohorts(rows: DataFrame, keys: list[str], value: str = "duration_ms") -> DataFrame:
    """n, sum, mean, max, p50, p95 of each cohort, and whether p95 rests on too few samples."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum_ms"), (F.sum(value) / F.count(F.lit(1))).alias("mean_ms"), F.max(value).alias("max_ms"),
        nearest_rank(value, 0.5).alias("p50_ms"), nearest_rank(value, 0.95).alias("p95_ms"), (F.count(F.lit(1)) < FEW).alias("low_sample"),
    )


def mix(rows: DataFrame, keys: list[str], value: str, members: list[str]) -> DataFrame:
    """Count and share of each member of a fixed set within a partition; members without rows count 0, shares of nothing are null."""
    wide = rows.groupBy(*keys).agg(*[F.count_if(F.col(value) == m).alias(m) for m in members])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).alias("n")) for m in members])).alias("_p")
    long = wide.select(*keys, pairs).select(*keys, "_p.member", "_p.n")
    total = F.sum("n").over(W.partitionBy(*keys))
    return long.withColumn("share", fraction(F.col("n"), total))


def exclusions(rows: DataFrame, keys: list[str], reason: Column, reasons: list[str]) -> DataFrame:
    """Each row has one reason or is eligible; per partition the counts add up to its rows."""
    marked = rows.withColumn("_why", F.coalesce(reason, F.lit("eligible")))
    return mix(marked, keys, "_why", ["eligible", *reasons]).withColumnRenamed("member", "reason")


def dedup_responses(rows: DataFrame, keys: list[str], row_id: str, payload: list[str]) -> DataFrame:
    """Copies of a response are one row, of the smallest id; a group whose payloads differ is withheld whole.

    Returns keys, representative id, copies, conflicted.
    """
    whole = F.struct(*payload)
    return rows.groupBy(*keys).agg(F.min(row_id).alias("representative"), F.count(F.lit(1)).alias("copies"), (F.min(whole) != F.max(whole)).alias("conflicted"))


def component_sums(rows: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """Sums in which one unknown member makes the component unknown."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[complete_sum(F.col(c)).alias(c) for c in components])


def failure_partitions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Terminal, completed and failed executions; the rate of no terminal ones is null."""
    out = rows.groupBy(*keys).agg(F.count_if(F.col("status").isin("completed", "failed")).alias("terminal"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("failed_share", fraction(F.col("failed"), F.col("terminal")))


def slow_groups(rows: DataFrame, partition: list[str], group: list[str], least: int = 5, share: float = 0.2) -> DataFrame:
    """Groups that take at least ``share`` of their partition's known time in ``least`` or more calls, ranked by time."""
    sums = rows.where("duration_ms is not null").groupBy(*partition, *group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("sum_ms"), nearest_rank("duration_ms", 0.5).alias("p50_ms"), nearest_rank("duration_ms", 0.95).alias("p95_ms"),
    )
    whole = F.sum("sum_ms").over(W.partitionBy(*partition))
    found = sums.withColumn("total_ms", whole).where((F.col("n") >= least) & (F.col("total_ms") > 0)).withColumn("share", F.col("sum_ms") / F.col("total_ms")).where(F.col("share") >= share)
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*partition).orderBy(F.desc("sum_ms"), F.desc("n"), *group)))


def breakdown(rows: DataFrame, partition: list[str], group: str, most: int) -> DataFrame:
    """The longest calls of each group with their ordinals, and the group's ordinal and share in its partition."""
    known = rows.where("duration_ms is not null")
    groups = known.groupBy(*partition, group).agg(F.sum("duration_ms").alias("group_ms"))
    groups = groups.withColumn("group_rank", F.row_number().over(W.partitionBy(*partition).orderBy(F.desc("group_ms"), group))).withColumn("group_share", fraction(F.col("group_ms"), F.sum("group_ms").over(W.partitionBy(*partition))))
    calls = known.withColumn("call_rank", F.row_number().over(W.partitionBy(*partition, group).orderBy(F.desc("duration_ms"), "id"))).where(F.col("call_rank") <= most)
    return calls.join(groups, [*partition, group]).select(*partition, group, "group_rank", "group_ms", "group_share", "call_rank", "id", "duration_ms")


def revisits(rows: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Accesses, distinct identities and the repeated share; any access without identity makes both unknown."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("accesses"), F.count(identity).alias("_known"), F.countDistinct(identity).alias("_distinct"))
    out = out.withColumn("distinct_keys", F.when(F.col("_known") == F.col("accesses"), F.col("_distinct")))
    return out.withColumn("repeat_share", fraction(F.col("accesses") - F.col("distinct_keys"), F.col("accesses"))).drop("_known", "_distinct")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each partition, each with how many there are and how many are left out."""
    by = W.partitionBy(*keys)
    out = rows.withColumn("position", F.row_number().over(by.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(by))
    return out.where(F.col("position") <= k).withColumn("omitted", F.greatest(F.col("total") - k, F.lit(0).cast("long")))
