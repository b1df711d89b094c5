"""The given tables as normalised agent-log tables.

The mapping is synthetic: it gives the ``events`` and ``conversations`` tables the
columns of the normalised schema, so that every analysis runs on data of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.expr import ntz_ms

CATEGORY = {"view": "read", "click": "search", "signup": "edit", "purchase": "validation", "error": "command"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool executions: id (stands for the byte offset), session, turn, tool, category, status, times, keys."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    category = F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])[kind]
    out = raw.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.expr("event_id div 500").alias("turn_id"), kind.alias("tool"), category.alias("category"),
        F.when(kind == "error", "failed").otherwise("completed").alias("status"), ntz_ms("ts").alias("start_ms"), F.floor(F.col("value") * 60000 + 0.5).cast("long").alias("duration_ms"),
        F.get_json_object("props", "$.k").alias("op_key"), F.when(kind.isin("purchase", "signup"), "runtime").otherwise("lifecycle").alias("scope"),
    )
    return out.withColumn("end_ms", F.col("start_ms") + F.col("duration_ms")).withColumn("source_id", F.pmod("session_id", F.lit(7)))


#: The same view for DuckDB.
EVENTS_SQL = """ev AS (
  SELECT *, start_ms + duration_ms AS end_ms, session_id % 7 AS source_id FROM (
    SELECT event_id AS id, user_id AS session_id, event_id // 500 AS turn_id, event_type AS tool,
      CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'signup' THEN 'edit' WHEN 'purchase' THEN 'validation' WHEN 'error' THEN 'command' END AS category,
      CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
      epoch_us(ts) // 1000 AS start_ms, CAST(floor(value * 60000 + 0.5) AS BIGINT) AS duration_ms, props->>'$.k' AS op_key,
      CASE WHEN event_type IN ('purchase', 'signup') THEN 'runtime' ELSE 'lifecycle' END AS scope
    FROM events))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage of responses, from order lines: one line is one usage row; some components are unknown."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.col("l_linenumber")
    return raw.select(
        F.col("l_orderkey").alias("response_id"), line.cast("long").alias("line"), F.pmod("l_suppkey", F.lit(13)).cast("long").alias("session_id"),
        F.col("l_quantity").cast("long").alias("input"), F.floor(F.col("l_quantity") / 2).cast("long").alias("cached_input"), F.col("l_linenumber").cast("long").alias("output"),
        F.when(F.pmod("l_partkey", F.lit(17)) != 0, F.lit(1).cast("long")).alias("reasoning_output"), ntz_ms("l_shipdate").alias("seen_ms"),
    )


USAGE_SQL = """us AS (
  SELECT l_orderkey AS response_id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_suppkey % 13 AS BIGINT) AS session_id, CAST(floor(l_quantity) AS BIGINT) AS input,
    CAST(floor(l_quantity / 2) AS BIGINT) AS cached_input, CAST(l_linenumber AS BIGINT) AS output,
    CASE WHEN l_partkey % 17 <> 0 THEN CAST(1 AS BIGINT) END AS reasoning_output, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000 AS seen_ms
  FROM lineitem)"""
