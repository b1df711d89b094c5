"""Links between records: polls to processes, wrappers, message graphs, rule overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.functions.saved import saved
from traceloom.operators import intervals


def linked_polls(polls: DataFrame, processes: DataFrame) -> DataFrame:
    """Adds ``event_id``: the execution that launched a poll's process; null if none or several claim it.

    polls: id, session_id, process_id; processes: session_id, process_id, event_id.
    """
    owner = processes.groupBy("session_id", "process_id").agg(F.min("event_id").alias("_a"), F.max("event_id").alias("_b")).where("_a = _b")
    return polls.join(owner, ["session_id", "process_id"], "left").withColumn("event_id", F.col("_a")).drop("_a", "_b")


def without_wrappers(events: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Executions that are not wrappers of others. wrappers: wrapper_id."""
    return events.join(wrappers.select(F.col("wrapper_id").alias("id")).distinct(), "id", "left_anti")


def message_graph(messages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds parent (the message before), depth, and whether a gap in the order cuts the chain."""
    by = W.partitionBy(*keys).orderBy(order)
    out = messages.withColumn("parent", F.lag(order).over(by)).withColumn("depth", F.row_number().over(by).cast("long") - 1)
    return out.withColumn("cut", F.coalesce(F.col(order) - F.col("parent") != 1, F.lit(False)))


def rule_overlap(occurrences: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Per partition: time of any rule, of two or more at once, and the excess of the rules' sum over their union.

    Intervals of one rule are united first, so that a rule never overlaps itself.
    """
    united = intervals.islands(occurrences, [*keys, rule]).select(*keys, rule, F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"))
    united = saved(united)  # read for its sums and for the sweep
    total = united.groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("rule_ms"))
    # Of one rule no two are left that touch, so changes of a block of time tell how many rules there are. A row of a tie has no length.
    block = [*keys, "_block"]
    change = F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("c")
    changes = intervals.cut_blocks(united, "_block", intervals.DAY).select(*block, change).select(*block, "c.t", "c.d").repartition(*block)
    order = W.partitionBy(*block).orderBy("t")
    swept = changes.select(*keys, F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("_active"), (F.lead("t").over(order) - F.col("t")).alias("_length"))
    at = swept.groupBy(*keys).agg(*[F.sum(F.when(F.col("_active") >= n, F.col("_length")).otherwise(0)).alias(c) for c, n in (("busy_ms", 1), ("multi_kind_ms", 2))])
    return total.join(at, keys, "left").select(*keys, "rule_ms", F.coalesce("busy_ms", F.lit(0).cast("long")).alias("union_ms"), F.coalesce("multi_kind_ms", F.lit(0).cast("long")).alias("overlap_ms"), (F.col("rule_ms") - F.coalesce("busy_ms", F.lit(0).cast("long"))).alias("excess_ms"))
