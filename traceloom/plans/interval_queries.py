"""Interval analyses and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import cohorts, history, intervals
from traceloom.sources.driver_tables import EVENTS_SQL, events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = 86_400_000
#: A period in the middle of the event table's month.
FROM_MS, TO_MS = 1_705_276_800_000, 1_706_140_800_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def islands_sql(source: str, keys: str) -> str:
    return f"""m AS (SELECT *, max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms, id) AS island FROM m),
isl AS (SELECT {keys}, island, min(start_ms) AS lo, max(end_ms) AS hi, count(*) AS members, sum(end_ms - start_ms) AS summed FROM n GROUP BY {keys}, island)"""


def unions_sql(source: str, keys: str) -> str:
    return f"""WITH {EVENTS_SQL}, {islands_sql(source, keys)} SELECT {keys}, CAST(sum(members) AS BIGINT) AS n, CAST(sum(summed) AS BIGINT) AS sum_ms, CAST(sum(hi - lo) AS BIGINT) AS union_ms,
CAST(sum(summed) - sum(hi - lo) AS BIGINT) AS excess_ms, max(hi) - min(lo) AS span_ms FROM isl GROUP BY {keys}"""


@query(unions_sql("ev", "session_id"))
def interval_union(spark, sf_dir):
    return intervals.union_length(events(spark, sf_dir), ["session_id"])


@query(f"SELECT session_id, tool, n, sum_ms, union_ms, excess_ms FROM ({unions_sql('ev', 'session_id, tool')})")
def overlap_excess(spark, sf_dir):
    return intervals.union_length(events(spark, sf_dir), ["session_id", "tool"]).drop("span_ms")


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT session_id, turn_id AS id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM ev GROUP BY ALL), {islands_sql('t', 'session_id')}
SELECT session_id, CAST(sum(members) AS BIGINT) AS turns, CAST(sum(hi - lo) AS BIGINT) AS active_ms, max(hi) - min(lo) AS span_ms FROM isl GROUP BY session_id""")
def active_span(spark, sf_dir):
    turns = events(spark, sf_dir).groupBy("session_id", F.col("turn_id").alias("id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return intervals.union_length(turns, ["session_id"]).select("session_id", F.col("n").alias("turns"), F.col("union_ms").alias("active_ms"), "span_ms")


@query(f"SELECT session_id, scope, n, sum_ms, union_ms AS busy_ms FROM ({unions_sql('ev', 'session_id, scope')})")
def tool_busy(spark, sf_dir):
    return intervals.union_length(events(spark, sf_dir), ["session_id", "scope"]).select("session_id", "scope", "n", "sum_ms", F.col("union_ms").alias("busy_ms"))


_SEGMENTS = """p AS (SELECT DISTINCT session_id, start_ms AS t_ms FROM ev WHERE start_ms < end_ms UNION SELECT DISTINCT session_id, end_ms FROM ev WHERE start_ms < end_ms),
s AS (SELECT session_id, t_ms, lead(t_ms) OVER (PARTITION BY session_id ORDER BY t_ms) AS next_ms FROM p),
g AS (SELECT s.session_id, s.t_ms, s.next_ms, count(e.id) AS active, count(DISTINCT e.category) AS kinds, min(e.category) AS kind
  FROM s LEFT JOIN ev e ON e.session_id = s.session_id AND e.start_ms <= s.t_ms AND e.end_ms >= s.next_ms AND e.start_ms < e.end_ms WHERE s.next_ms IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {EVENTS_SQL}, {_SEGMENTS} SELECT session_id, CAST(sum(CASE WHEN active > 0 THEN next_ms - t_ms ELSE 0 END) AS BIGINT) AS busy_ms,
CAST(sum(CASE WHEN active > 1 THEN next_ms - t_ms ELSE 0 END) AS BIGINT) AS concurrent_ms, CAST(sum(CASE WHEN kinds > 1 THEN next_ms - t_ms ELSE 0 END) AS BIGINT) AS multi_kind_ms FROM g GROUP BY session_id""")
def sweep_concurrency(spark, sf_dir):
    return intervals.concurrency(intervals.sweep(events(spark, sf_dir), ["session_id"], "category"), ["session_id"])


@query(f"WITH {EVENTS_SQL}, {_SEGMENTS} SELECT session_id, kind, CAST(sum(next_ms - t_ms) AS BIGINT) AS exclusive_ms FROM g WHERE kinds = 1 GROUP BY ALL")
def sweep_exclusive(spark, sf_dir):
    return intervals.exclusive(intervals.sweep(events(spark, sf_dir), ["session_id"], "category"), ["session_id"])


@query(unions_sql("c", "session_id").replace("WITH " + EVENTS_SQL, f"WITH {EVENTS_SQL}, c AS (SELECT id, session_id, greatest(start_ms, {FROM_MS}) AS start_ms, least(end_ms, {TO_MS}) AS end_ms FROM ev WHERE end_ms > {FROM_MS} AND start_ms < {TO_MS})"))
def period_clip(spark, sf_dir):
    return intervals.union_length(intervals.clip(events(spark, sf_dir), FROM_MS, TO_MS), ["session_id"])


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT session_id, id, tool, start_ms - min(start_ms) OVER w AS offset_ms, duration_ms, max(end_ms) OVER w - min(start_ms) OVER w AS axis_ms,
row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, id) AS position, count(*) OVER w AS total FROM ev WINDOW w AS (PARTITION BY session_id))
SELECT *, greatest(total - 20, 0) AS omitted FROM r WHERE position <= 20""")
def invocation_timeline(spark, sf_dir):
    from pyspark.sql.window import Window as W

    by = W.partitionBy("session_id")
    rows = events(spark, sf_dir).withColumn("first_ms", F.min("start_ms").over(by)).withColumn("axis_ms", F.max("end_ms").over(by) - F.col("first_ms")).withColumn("offset_ms", F.col("start_ms") - F.col("first_ms"))
    top = cohorts.top_k(rows, ["session_id"], [F.col("start_ms"), F.col("end_ms"), F.col("id")], 20)
    return top.withColumn("position", F.col("position").cast("long")).select("session_id", "id", "tool", "offset_ms", "duration_ms", "axis_ms", "position", "total", "omitted")


_OFFSET = 330


@query(f"""WITH {EVENTS_SQL}, done AS (SELECT (end_ms + {_OFFSET * 60000}) // {DAY} AS day, count(*) AS completions FROM ev WHERE end_ms >= {FROM_MS} AND end_ms < {TO_MS} GROUP BY 1),
c AS (SELECT id, session_id, greatest(start_ms, {FROM_MS}) AS start_ms, least(end_ms, {TO_MS}) AS end_ms FROM ev WHERE end_ms > {FROM_MS} AND start_ms < {TO_MS}),
x AS (SELECT *, unnest(range((start_ms + {_OFFSET * 60000}) // {DAY}, (end_ms - 1 + {_OFFSET * 60000}) // {DAY} + 1)) AS day FROM c WHERE end_ms > start_ms),
y AS (SELECT id, session_id, day, greatest(start_ms, day * {DAY} - {_OFFSET * 60000}) AS start_ms, least(end_ms, (day + 1) * {DAY} - {_OFFSET * 60000}) AS end_ms FROM x),
{islands_sql('y', 'session_id, day')}, b AS (SELECT day, CAST(sum(hi - lo) AS BIGINT) AS busy_ms FROM isl GROUP BY day)
SELECT coalesce(done.day, b.day) AS day, coalesce(completions, 0) AS completions, coalesce(busy_ms, 0) AS busy_ms FROM done FULL JOIN b ON done.day = b.day""")
def history_days(spark, sf_dir):
    return history.days(events(spark, sf_dir), FROM_MS, TO_MS, history.parse_offset("+05:30"))
