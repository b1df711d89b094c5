"""Whole results or none: JSON envelopes whose size is known before anything is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: bytes that a result may have.
LIMIT = 8 << 20


class TooLarge(ValueError):
    """A result is beyond the limit; nothing of it was written."""


def _line(columns: list[str], schema: str, command: str) -> Column:
    envelope = F.struct(F.lit(schema).alias("schema"), F.lit(True).alias("ok"), F.lit(command).alias("command"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("result"))
    return F.to_json(envelope, {"ignoreNullFields": "false"})


def lines(rows: DataFrame, schema: str, command: str) -> DataFrame:
    """One JSON line for each row: {schema, ok, command, result}; nulls are kept."""
    return rows.select(_line(rows.columns, schema, command).alias("value"))


def measured(rows: DataFrame, keys: list[str], schema: str, command: str, limit: int = LIMIT) -> DataFrame:
    """Per key: lines and bytes (line ends included) of its result, and whether it is refused. Sizes are summed where the rows are."""
    sized = rows.select(*keys, (F.octet_length(_line(rows.columns, schema, command)) + 1).cast("long").alias("_bytes"))
    return sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.sum("_bytes").alias("bytes")).withColumn("refused", F.col("bytes") > limit)


def publish(rows: DataFrame, path: str, schema: str, command: str, limit: int = LIMIT) -> int:
    """Writes the lines of a result to a new folder and returns their bytes; raises before anything is written if they are too many."""
    told = lines(rows, schema, command)
    size = told.agg(F.sum(F.octet_length("value").cast("long") + 1)).first()[0] or 0
    if size > limit:
        raise TooLarge(f"{size} bytes; a result may have {limit}")
    told.write.mode("errorifexists").text(path)
    return size
