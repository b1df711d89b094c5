"""Message graphs: parents as an edge table, roots and depths by doubling of pointers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.saved import saved


def messages(copies: DataFrame, keys: list[str], digest: str, order: str) -> DataFrame:
    """One row for each message (keys and ``id``) of records that may repeat it: the first's parent, copies, and whether copies differ."""
    own = F.struct(order, "parent")
    return copies.groupBy(*keys, "id").agg(F.min(own)["parent"].alias("parent"), F.count(F.lit(1)).alias("copies"), (F.min(digest) != F.max(digest)).alias("conflicted"))


def roots(nodes: DataFrame, keys: list[str], stream: list[str] | None = None) -> DataFrame:
    """Adds root, depth and state to nodes (keys, id, parent; ids are unique within keys).

    state: ``root`` (no parent), ``missing_parent`` (it names one that isn't there), ``linked``, or ``cycle`` (it is
    in a circle or hangs on one; root and depth are null). Below a message whose parent is
    missing that message is the root. Each round every pointer skips as far as the rounds
    before it together, so a chain of a million takes some 20 rounds; a pointer that has
    not arrived when it must have is on a circle. Pointers that have arrived are not
    joined again, so that a popular root is no hot key.
    """
    there = nodes.select(*keys, F.col("id").alias("parent"), F.lit(True).alias("_there"))
    linked = nodes.join(there, [*keys, "parent"], "left")
    top = F.col("parent").isNull() | F.col("_there").isNull()
    state = saved(linked.select(*keys, "id", F.when(top, F.col("id")).otherwise(F.col("parent")).alias("up"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done"), F.when(F.col("parent").isNull(), "root").when(top, "missing_parent").otherwise("linked").alias("kind")))
    most = state.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(max(2, most))) + 1):
        if state.where("NOT done").isEmpty():
            break
        ahead = state.select(*keys, F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        # A pointer has arrived if what it points to is a root.
        moved = state.where("NOT done").join(ahead, [*keys, "up"])
        arrived = F.col("_done") & (F.col("_up") == F.col("up"))
        moved = moved.select(*keys, "id", F.when(arrived, F.col("up")).otherwise(F.col("_up")).alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"), "kind")
        state = saved(state.where("done").unionByName(moved))
    found = state.select(*keys, "id", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"), F.when(F.col("done"), F.col("kind")).otherwise("cycle").alias("state"))
    return nodes.join(found, [*keys, "id"])
