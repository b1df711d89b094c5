"""Connected components of an edge table: forests within tasks, then large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.scratch import Scratch, looked_up


def _forest(batches):
    """The edges of one task as stars around the least node of each component that they form."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    leaves = [x for x in up if up[x] != x]
    yield pa.RecordBatch.from_pydict({"u": pa.array(leaves, pa.int64()), "v": pa.array([root(x) for x in leaves], pa.int64())})


def _least_neighbour(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("c"))


def components(edges: DataFrame, scratch: Scratch, name: str, edges_per_task: int = 500_000, most_steps: int = 200) -> DataFrame:
    """``node``, ``label`` (the least node of its component) for every node of ``edges`` (long columns a, b).

    Each task first reduces up to ``edges_per_task`` edges to a forest. The forests of
    several tasks are joined by star steps until all edges are stars around the least
    nodes, a number of steps that grows with the logarithm of the largest component. Each
    step is saved in the shared folder, so lineage stays short, and no task ever holds more
    edges than that bound. Labels that are not final after ``most_steps`` are an error.
    """
    kept = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    tasks = max(1, -(-kept.count() // edges_per_task))
    state, before = scratch.save(kept.repartition(tasks).mapInArrow(_forest, "u long, v long"), f"{name}-0"), None
    for step in range(1, most_steps + 1):
        if tasks == 1:
            break
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        sym = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = looked_up(sym, _least_neighbour(sym), ["u"], "c", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = looked_up(large, low, ["u"], "c", now[0]).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        state = scratch.save(small, f"{name}-{step}")
    else:
        raise RuntimeError(f"{name}: components are not final after {most_steps} steps")
    return state.select(F.col("u").alias("node"), F.col("v").alias("label")).union(state.select(F.col("v"), F.col("v")).distinct())
