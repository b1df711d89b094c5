"""Interval algebra over columns start, end (half-open, milliseconds) and any partition keys.

Everything is windows and grouped sums keyed by the partition and a block of time, so that
a partition with very many intervals is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DAY = 86_400_000


def islands(rows: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", tie: str = "id") -> DataFrame:
    """Maximal unions of touching intervals: keys, lo, hi, members, summed."""
    order = W.partitionBy(*keys).orderBy(start, end, tie)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias("lo"), F.max(end).alias("hi"), F.count(F.lit(1)).alias("members"), F.sum(F.col(end) - F.col(start)).alias("summed")).drop("_island")


def union_length(rows: DataFrame, keys: list[str], block_ms: int = DAY) -> DataFrame:
    """Per partition: number, sum, union, excess (sum less union) and span of its intervals.

    A partition is worked on in blocks of its starts, so that one with very many intervals
    is many tasks. Islands of a block are disjoint; how far earlier blocks reach is one
    number, found over one row for each block, and cuts what they cover already.
    """
    block = F.floor(F.col("start_ms") / F.lit(float(block_ms))).cast("long")
    parts = islands(rows.withColumn("_block", block), [*keys, "_block"])
    earlier = W.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    # Named apart and joined null-safe: a null key is a partition like any other.
    ends = parts.groupBy(*keys, "_block").agg(F.max("hi").alias("_hi")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_at"), "_hi").withColumn("_reach", F.max("_hi").over(earlier))
    same = F.col("_block").eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    reached = parts.join(ends, same)
    new = F.greatest(F.col("hi") - F.greatest("lo", F.coalesce("_reach", "lo")), F.lit(0).cast("long"))
    out = reached.groupBy(*keys).agg(F.sum("members").alias("n"), F.sum("summed").alias("sum_ms"), F.sum(new).alias("union_ms"), (F.max("hi") - F.min("lo")).alias("span_ms"))
    return out.select(*keys, "n", "sum_ms", "union_ms", (F.col("sum_ms") - F.col("union_ms")).alias("excess_ms"), "span_ms")


def clip(rows: DataFrame, start_ms: int | Column, end_ms: int | Column) -> DataFrame:
    """The parts inside [start_ms, end_ms); what ends at or before it, or starts at or after its end, goes."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (start_ms, end_ms))
    inside = rows.where((F.col("end_ms") > lo) & (F.col("start_ms") < hi))
    return inside.withColumn("start_ms", F.greatest("start_ms", lo)).withColumn("end_ms", F.least("end_ms", hi))


def sweep(rows: DataFrame, keys: list[str], kind: str, block_ms: int = DAY) -> DataFrame:
    """Elementary segments between endpoints: keys, t_ms, next_ms, active, active_kinds, the only kind if one.

    All changes at an instant apply together; intervals without length change nothing.
    Intervals are cut at the borders of blocks of time first, so each block is a sweep of
    its own that needs nothing of the others, and a border in an interval ends a segment.
    Time that no interval covers may lack segments.
    """
    live = cut_blocks(rows.where("start_ms < end_ms").select(*keys, F.col(kind).alias("_kind"), "start_ms", "end_ms"), "_block", block_ms)
    part_keys = [*keys, "_block"]
    ends = live.select(*part_keys, "_kind", F.col("start_ms").alias("t_ms"), F.lit(1).alias("_d")).union(live.select(*part_keys, "_kind", "end_ms", F.lit(-1)))
    by_kind = ends.groupBy(*part_keys, "_kind", "t_ms").agg(F.sum("_d").alias("_d"))
    part, part_kind = W.partitionBy(*part_keys).orderBy("t_ms"), W.partitionBy(*part_keys, "_kind").orderBy("t_ms")
    # How many kinds are active changes where a kind's own count leaves or meets zero.
    by_kind = by_kind.withColumn("_a", F.sum("_d").over(part_kind)).withColumn("_p", F.col("_a") - F.col("_d"))
    by_kind = by_kind.withColumn("_on", F.when((F.col("_a") > 0) & (F.col("_p") == 0), 1).when((F.col("_a") == 0) & (F.col("_p") > 0), -1).otherwise(0))
    code = F.xxhash64("_kind").cast("decimal(38,0)")
    at = by_kind.groupBy(*part_keys, "t_ms").agg(F.sum("_d").alias("_d"), F.sum("_on").alias("_on"), F.sum(code * F.col("_on")).alias("_code"))
    names = rows.where("start_ms < end_ms").select(F.col(kind).alias("only_kind")).distinct().withColumn("_active", F.xxhash64("only_kind").cast("decimal(38,0)"))
    run = at.select(*keys, "t_ms", F.lead("t_ms").over(part).alias("next_ms"), F.sum("_d").over(part).alias("active"), F.sum("_on").over(part).alias("active_kinds"), F.sum("_code").over(part).cast("decimal(38,0)").alias("_code"))
    run = run.where("next_ms is not null").withColumn("_active", F.when(F.col("active_kinds") == 1, F.col("_code")))
    return run.join(names, "_active", "left").drop("_active", "_code")


def concurrency(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Busy, concurrent and multi-kind time of each partition."""
    length = F.col("next_ms") - F.col("t_ms")

    def over(condition: str) -> Column:
        return F.sum(F.when(F.expr(condition), length).otherwise(0))

    return segments.groupBy(*keys).agg(over("active > 0").alias("busy_ms"), over("active > 1").alias("concurrent_ms"), over("active_kinds > 1").alias("multi_kind_ms"))


def exclusive(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Time in which one kind alone is active, for each partition and kind."""
    return segments.where("active_kinds = 1").groupBy(*keys, F.col("only_kind").alias("kind")).agg(F.sum(F.col("next_ms") - F.col("t_ms")).alias("exclusive_ms"))


def cut_blocks(rows: DataFrame, name: str, width: int, shift: int = 0) -> DataFrame:
    """The part of each interval with a length in each block of ``width`` ms; adds the block's number."""
    floor = lambda c: F.floor((c + shift) / F.lit(float(width))).cast("long")
    parts = rows.where("end_ms > start_ms").withColumn(name, F.explode(F.sequence(floor(F.col("start_ms")), floor(F.col("end_ms") - 1))))
    low, high = F.col(name) * width - shift, (F.col(name) + 1) * width - shift
    return parts.withColumn("start_ms", F.greatest("start_ms", low)).withColumn("end_ms", F.least("end_ms", high))


def split_days(rows: DataFrame, offset_minutes: int = 0) -> DataFrame:
    """The part of each interval in each day of a fixed offset: day (days since the epoch), start_ms, end_ms."""
    return cut_blocks(rows, "day", DAY, offset_minutes * 60_000)
