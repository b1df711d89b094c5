"""Logs that are looked at twice, over two generations of logs written from the event table, and the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.saved import saved, work_folder
from traceloom.sources import appends
from traceloom.sources.driver_tables import EVENTS_SQL, events
from traceloom.sources.written import write_named

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SOURCES = 40


#: Of each source, what its second generation is: as it was, longer, changed, shorter, or the first.
_SECOND = "CASE source % 5 WHEN 0 THEN id < cut WHEN 3 THEN id < cut / 2 ELSE true END"
_FIRST = "id < cut AND source % 5 <> 4"


def _generations(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir)
    cut = (rows.agg(F.max("id")).first()[0] or 0) * 6 // 10
    rows = rows.select("id", F.pmod("session_id", F.lit(SOURCES)).alias("source"), "tool", F.lit(cut).alias("cut"))
    line = lambda tool: F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"tool":"'), tool, F.lit('"}'))
    second = F.when((F.col("source") % 5 == 2) & (F.col("id") % 17 == 0), F.lit("other")).otherwise(F.col("tool"))
    return (rows.where(_FIRST).select("source", "id", line(F.col("tool")).alias("line")), rows.where(_SECOND).select("source", "id", line(second).alias("line")))


def log_appends(spark, sf_dir: str):
    """A second look at logs of which some were appended to, rewritten or cut: what of each is parsed, and what then is stored."""
    folder = work_folder(spark, "logs")
    first, second = _generations(spark, sf_dir)
    write_named(first, folder)
    one = appends.advance(spark, folder, "codex")
    records, proofs = saved(one.records), saved(one.proofs)
    write_named(second, folder)
    two = appends.advance(spark, folder, "codex", proofs)
    now = appends.merged(records, two).groupBy("source_id").agg(F.count(F.lit(1)).alias("records"), F.max("ordinal").alias("last_ordinal"), F.sum(F.octet_length("raw").cast("long")).alias("bytes"))
    name = F.regexp_extract("file", r"source-(\d+)\.jsonl$", 1).cast("long")
    return two.outcomes.join(now, "source_id").select(name.alias("source"), "status", "parsed_bytes", "records", "last_ordinal", "bytes")


QUERIES["log_appends"] = log_appends
ORACLES["log_appends"] = f"""WITH {EVENTS_SQL}, e AS (SELECT id, session_id % {SOURCES} AS source, tool, (SELECT max(id) * 6 // 10 FROM ev) AS cut FROM ev),
l AS (SELECT *, '{{"id":' || id || ',"tool":"' || tool || '"}}' AS one, '{{"id":' || id || ',"tool":"' || CASE WHEN source % 5 = 2 AND id % 17 = 0 THEN 'other' ELSE tool END || '"}}' AS two FROM e),
g AS (SELECT source, coalesce(string_agg(one || chr(10), '' ORDER BY id) FILTER ({_FIRST}), '') AS a, coalesce(string_agg(two || chr(10), '' ORDER BY id) FILTER ({_SECOND}), '') AS b FROM l GROUP BY source),
s AS (SELECT source, a, CASE WHEN b = '' THEN a ELSE b END AS b FROM g WHERE a <> '' OR b <> ''),
t AS (SELECT *, CASE WHEN a = '' THEN 'new' WHEN a = b THEN 'unchanged' WHEN strlen(b) < strlen(a) THEN 'truncated' WHEN starts_with(b, a) THEN 'appended' ELSE 'rewritten' END AS status, len(b) - len(replace(b, chr(10), '')) AS n FROM s)
SELECT source, status, CAST(CASE status WHEN 'unchanged' THEN 0 WHEN 'appended' THEN strlen(b) - strlen(a) ELSE strlen(b) END AS BIGINT) AS parsed_bytes, CAST(n AS BIGINT) AS records, CAST(n - 1 AS BIGINT) AS last_ordinal, CAST(strlen(b) - n AS BIGINT) AS bytes FROM t"""
