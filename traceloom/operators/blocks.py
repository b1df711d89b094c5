"""Running values over ordered partitions of any size.

A window over a partition puts it in one task. Here the window covers one block of the
order at a time, and what a block takes over from those before it (sums, the last row's
values) is found over one row for each block. A block is a stretch of the order column of
fixed width, so that with distinct order values it holds no more rows than that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Width of a block of ids or byte offsets.
WIDTH = 1 << 20
_KEY, _HASH = "_block_key", "_block_hash"


def hashed(key: str) -> Column:
    """A number that goes before a struct in window, grouping and join: rows are sorted by it at a glance, by the struct only where it is equal."""
    return F.xxhash64(key)


def running(
    rows: DataFrame, keys: list[str], order: str, width: int = WIDTH, sums: dict[str, Column] | None = None, inclusive: bool = True,
    previous: dict[str, str] | None = None, following: dict[str, str] | None = None, tie: str | None = None,
) -> DataFrame:
    """Adds running sums, and columns of the row before and after, in the order of a numeric column within ``keys``.

    ``sums`` maps new columns to numeric terms (a null term adds nothing; the sum before any
    term is 0), up to the row or, if not ``inclusive``, up to the one before. ``previous``
    and ``following`` map new columns to existing ones; null where there is no such row.
    Null keys are a partition like any other; rows with a null order value come first, as
    one block. Values of ``order`` are distinct within a partition, or ``tie`` orders equal ones; else ties come in any order.
    """
    sums, previous, following = sums or {}, previous or {}, following or {}
    block = F.floor(F.col(order) / F.lit(float(width))).cast("long").alias("block")
    # One struct names partition and block: structs compare null-safe, so window, grouping and join share one shuffle.
    key = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], block)
    marked = rows.withColumns({_KEY: key} | {f"_term_{n}": c for n, c in sums.items()}).withColumn(_HASH, hashed(_KEY))
    place = [order, tie] if tie else [order]
    within = W.partitionBy(_HASH, _KEY).orderBy(*place)
    upto = within.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    # A struct around the value tells a null value from a missing row.
    local = {n: F.coalesce(F.sum(f"_term_{n}").over(upto), F.lit(0)) for n in sums}
    local |= {n: F.lag(F.struct(F.col(c).alias("v"))).over(within) for n, c in previous.items()}
    local |= {n: F.lead(F.struct(F.col(c).alias("v"))).over(within) for n, c in following.items()}
    here = marked.withColumns(local)

    ends = [F.sum(f"_term_{n}").alias(f"_s_{n}") for n in sums]
    ends += [F.max(F.struct(*place, F.struct(F.col(c).alias("v")).alias("w")))["w"].alias(f"_s_{n}") for n, c in previous.items()]
    ends += [F.min(F.struct(*place, F.struct(F.col(c).alias("v")).alias("w")))["w"].alias(f"_s_{n}") for n, c in following.items()]
    blocks = marked.groupBy(_HASH, _KEY).agg(*ends)
    across = W.partitionBy(*[F.col(_KEY)[f"k{i}"] for i in range(len(keys))]).orderBy(F.col(_KEY)["block"])
    carried = {f"_c_{n}": F.coalesce(F.sum(f"_s_{n}").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for n in sums}
    carried |= {f"_c_{n}": F.lag(f"_s_{n}").over(across) for n in previous} | {f"_c_{n}": F.lead(f"_s_{n}").over(across) for n in following}
    joined = here.join(blocks.select(_HASH, _KEY, *[c.alias(n) for n, c in carried.items()]), [_HASH, _KEY])
    found = {n: (F.col(n) + F.col(f"_c_{n}")).alias(n) for n in sums} | {n: F.coalesce(n, f"_c_{n}")["v"].alias(n) for n in (*previous, *following)}
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *found.values())


def numbered(rows: DataFrame, keys: list[str], order: str, state: Column, fresh: Callable[[Column, Column], Column], name: str, width: int = WIDTH) -> DataFrame:
    """Adds ``name``: how many stretches have begun in the partition up to the row, from 1.

    A row begins a stretch if it is the first of its partition or if ``fresh`` holds for the
    ``state`` (a struct) of the row before and its own. A block tells its first and last
    state and how many stretches begin inside it; what lies between blocks is settled over
    one row for each. Values of ``order`` are distinct within a partition.
    """
    block = F.floor(F.col(order) / F.lit(float(width))).cast("long").alias("block")
    key = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], block)
    marked = rows.withColumns({_KEY: key, "_state": state}).withColumn(_HASH, hashed(_KEY))
    within = W.partitionBy(_HASH, _KEY).orderBy(order)
    met = marked.withColumn("_before", F.lag("_state").over(within))
    flag = F.when(F.col("_before").isNull(), 0).otherwise(fresh(F.col("_before"), F.col("_state")).cast("long"))
    here = met.withColumn("_flag", flag).withColumn("_local", F.sum("_flag").over(within.rowsBetween(W.unboundedPreceding, 0)))
    edge = F.struct(F.col(order).alias("o"), F.col("_state").alias("s"))
    blocks = here.groupBy(_HASH, _KEY).agg(F.max("_local").alias("_n"), F.min(edge)["s"].alias("_first"), F.max(edge)["s"].alias("_last"))
    across = W.partitionBy(*[F.col(_KEY)[f"k{i}"] for i in range(len(keys))]).orderBy(F.col(_KEY)["block"])
    blocks = blocks.withColumn("_prior", F.lag("_last").over(across))
    blocks = blocks.withColumn("_open", F.when(F.col("_prior").isNull(), 1).otherwise(fresh(F.col("_prior"), F.col("_first")).cast("long")))
    carried = blocks.select(_HASH, _KEY, (F.sum(F.col("_n") + F.col("_open")).over(across.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_carried"))
    return here.join(carried, [_HASH, _KEY]).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_carried") + F.col("_local")).alias(name))
