"""Links, rule overlaps and coverage views, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions.expr import fraction
from traceloom.operators import relations
from traceloom.plans.interval_queries import islands_sql
from traceloom.sources.driver_tables import EVENTS_SQL, USAGE_SQL, events, usage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {EVENTS_SQL}, o AS (SELECT session_id, op_key, min(id) AS a, max(id) AS b FROM ev WHERE tool = 'purchase' GROUP BY ALL HAVING min(id) = max(id))
SELECT ev.id, ev.session_id, o.a AS event_id FROM ev LEFT JOIN o ON o.session_id = ev.session_id AND o.op_key = ev.op_key WHERE tool = 'view'""")
def poll_links(spark, sf_dir):
    rows = events(spark, sf_dir).withColumnRenamed("op_key", "process_id")
    owners = rows.where("tool = 'purchase'").select("session_id", "process_id", F.col("id").alias("event_id"))
    return relations.linked_polls(rows.where("tool = 'view'").select("id", "session_id", "process_id"), owners).select("id", "session_id", "event_id")


@query("SELECT conv_id, turn, lag(turn) OVER w AS parent, row_number() OVER w - 1 AS depth, coalesce(turn - lag(turn) OVER w <> 1, false) AS cut FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def message_graph(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    return relations.message_graph(talk, ["conv_id"], "turn")


_RULES = "occ AS (SELECT id, session_id, start_ms, end_ms, 'slow' AS rule FROM ev WHERE duration_ms > 2000000 UNION ALL SELECT id, session_id, start_ms, end_ms, 'failed' FROM ev WHERE status = 'failed' UNION ALL SELECT id, session_id, start_ms, end_ms, 'search' FROM ev WHERE category = 'search')"


@query(f"""WITH {EVENTS_SQL}, {_RULES}, {islands_sql('occ', 'session_id, rule')}, u AS (SELECT session_id, rule AS id, lo AS start_ms, hi AS end_ms FROM isl),
p AS (SELECT session_id, start_ms AS t FROM u UNION SELECT session_id, end_ms FROM u), s AS (SELECT session_id, t, lead(t) OVER (PARTITION BY session_id ORDER BY t) AS n FROM p),
g AS (SELECT s.session_id, s.n - s.t AS len, count(u.id) AS active FROM s JOIN u ON u.session_id = s.session_id AND u.start_ms <= s.t AND u.end_ms >= s.n AND u.start_ms < u.end_ms WHERE s.n IS NOT NULL GROUP BY s.session_id, s.t, s.n),
r AS (SELECT session_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS rule_ms FROM u GROUP BY 1), x AS (SELECT session_id, CAST(sum(len) AS BIGINT) AS union_ms, CAST(coalesce(sum(len) FILTER (active > 1), 0) AS BIGINT) AS overlap_ms FROM g GROUP BY 1)
SELECT r.session_id, rule_ms, coalesce(union_ms, 0) AS union_ms, coalesce(overlap_ms, 0) AS overlap_ms, rule_ms - coalesce(union_ms, 0) AS excess_ms FROM r LEFT JOIN x ON x.session_id = r.session_id""")
def pattern_overlap(spark, sf_dir):
    rows = events(spark, sf_dir).select("id", "session_id", "start_ms", "end_ms", "duration_ms", "status", "category")
    rules = [("slow", F.col("duration_ms") > 2_000_000), ("failed", F.col("status") == "failed"), ("search", F.col("category") == "search")]
    found = rows.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))))
    return relations.rule_overlap(found, ["session_id"], "rule")


@query(f"""WITH {USAGE_SQL} SELECT session_id, count(*) AS n, count(reasoning_output) AS complete, count(reasoning_output) / count(*) AS complete_share, count(*) FILTER (line = 1) AS final, count(*) FILTER (line > 1) AS provisional FROM us GROUP BY session_id""")
def usage_coverage(spark, sf_dir):
    out = usage(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count("reasoning_output").alias("complete"), F.count_if(F.col("line") == 1).alias("final"), F.count_if(F.col("line") > 1).alias("provisional"))
    return out.withColumn("complete_share", fraction(F.col("complete"), F.col("n")))


@query(f"WITH {EVENTS_SQL}, s AS (SELECT source_id, tool, count(*) AS n, count(DISTINCT op_key) AS shapes, min(id) AS first_id FROM ev GROUP BY ALL) SELECT *, n / CAST(sum(n) OVER (PARTITION BY source_id) AS BIGINT) AS share FROM s")
def shape_coverage(spark, sf_dir):
    from pyspark.sql.window import Window as W

    out = events(spark, sf_dir).groupBy("source_id", "tool").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("op_key").alias("shapes"), F.min("id").alias("first_id"))
    return out.withColumn("share", fraction(F.col("n"), F.sum("n").over(W.partitionBy("source_id"))))


@query(f"WITH {EVENTS_SQL}, s AS (SELECT source_id, session_id, count(*) AS events, max(id) AS last_id FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY source_id, session_id) AS position, count(*) OVER () AS total FROM s) SELECT source_id, session_id, events, last_id, total, total > 64 AS truncated FROM r WHERE position <= 64")
def source_catalogue(spark, sf_dir):
    out = events(spark, sf_dir).groupBy("source_id", "session_id").agg(F.count(F.lit(1)).alias("events"), F.max("id").alias("last_id"))
    listed = out.orderBy("source_id", "session_id").limit(64).withColumn("total", out.agg(F.count(F.lit(1))).scalar())
    return listed.withColumn("truncated", F.col("total") > 64)


@query(f"WITH {EVENTS_SQL} SELECT scope, tool, count(*) AS n, count(*) FILTER (duration_ms > 600000) AS long_n, count(*) FILTER (duration_ms > 600000) / count(*) AS long_share FROM ev GROUP BY ALL")
def timing_evidence(spark, sf_dir):
    out = events(spark, sf_dir).groupBy("scope", "tool").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("duration_ms") > 600_000).alias("long_n"))
    return out.withColumn("long_share", fraction(F.col("long_n"), F.col("n")))


@query(f"WITH {EVENTS_SQL}, w AS (SELECT DISTINCT id - id % 10 AS id FROM ev WHERE tool = 'click') SELECT session_id, count(*) AS executions FROM ev ANTI JOIN w USING (id) GROUP BY session_id")
def wrapper_exclusion(spark, sf_dir):
    rows = events(spark, sf_dir)
    wrappers = rows.where("tool = 'click'").select((F.col("id") - F.col("id") % 10).alias("wrapper_id"))
    return relations.without_wrappers(rows, wrappers).groupBy("session_id").agg(F.count(F.lit(1)).alias("executions"))
