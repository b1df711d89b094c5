"""Chains, windows and pattern rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions.expr import fraction
from traceloom.operators import blocks, cohorts, gates, intervals, sequences
from traceloom.plans.interval_queries import islands_sql
from traceloom.sources.driver_tables import EVENTS_SQL, events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MINUTE = 60_000
DAY = 86_400_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_CHAINS = """k AS (SELECT *, coalesce(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain FROM ev),
chains AS (SELECT session_id, CAST(chain AS BIGINT) AS chain, count(*) FILTER (status = 'failed') AS failures, bool_or(status = 'completed') AS resolved,
  CASE WHEN bool_or(status = 'completed') THEN max(end_ms) FILTER (status = 'completed') - min(end_ms) FILTER (status = 'failed') END AS elapsed_ms FROM k GROUP BY ALL HAVING count(*) FILTER (status = 'failed') > 0)"""


def _chains(spark, sf_dir):
    rows = events(spark, sf_dir)
    return sequences.recovery_chains(rows, ["session_id"], F.col("status") == "failed", F.col("status") == "completed")


@query(f"WITH {EVENTS_SQL}, {_CHAINS} SELECT * FROM chains")
def recovery_chains(spark, sf_dir):
    return _chains(spark, sf_dir)


@query(f"""WITH {EVENTS_SQL}, {_CHAINS} SELECT session_id, count(*) AS n, min(elapsed_ms) AS min_ms, CAST(quantile_disc(elapsed_ms, 0.5) AS BIGINT) AS p50_ms,
CAST(quantile_disc(elapsed_ms, 0.95) AS BIGINT) AS p95_ms, max(elapsed_ms) AS max_ms FROM chains WHERE resolved GROUP BY session_id""")
def recovery_distribution(spark, sf_dir):
    return _chains(spark, sf_dir).where("resolved").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("elapsed_ms").alias("min_ms"), cohorts.nearest_rank("elapsed_ms", 0.5).alias("p50_ms"), cohorts.nearest_rank("elapsed_ms", 0.95).alias("p95_ms"), F.max("elapsed_ms").alias("max_ms"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT * FROM ev WHERE status = 'failed'), {islands_sql('f', 'session_id, scope')},
o AS (SELECT session_id, scope, CAST(sum(members) AS BIGINT) AS attempts, CAST(sum(hi - lo) AS BIGINT) AS overhead_ms FROM isl GROUP BY ALL)
SELECT session_id, count(*) AS partitions, CAST(sum(attempts) AS BIGINT) AS attempts, CASE WHEN count(*) = 1 THEN CAST(max(overhead_ms) AS BIGINT) END AS overhead_ms FROM o GROUP BY session_id""")
def retry_overhead(spark, sf_dir):
    failed = events(spark, sf_dir).where("status = 'failed'")
    parts = intervals.union_length(failed, ["session_id", "scope"])
    return parts.groupBy("session_id").agg(F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("attempts"), F.when(F.count(F.lit(1)) == 1, F.max("union_ms")).alias("overhead_ms"))


def _episodes_sql(source: str, keys: str, least: int, window_ms: int) -> str:
    """Episodes by joining each row with its window, an independent form of the same definition."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY end_ms, id) - 1 AS rn FROM {source}),
w AS (SELECT a.*, (SELECT min(b.rn) FROM r b WHERE {" AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))} AND b.end_ms >= a.end_ms - {window_ms} AND b.rn <= a.rn) AS l FROM r a),
q AS (SELECT * FROM w WHERE rn - l + 1 >= {least}),
e AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND l <= prev THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY rn) AS ep FROM (SELECT *, lag(rn) OVER (PARTITION BY {keys} ORDER BY rn) AS prev FROM q)),
g AS (SELECT {keys}, ep, min(l) AS first_rn, max(rn) AS last_rn, max(end_ms) AS last_ms FROM e GROUP BY {keys}, ep)
SELECT {", ".join(f"g.{k}" for k in keys.split(", "))}, r.end_ms AS first_ms, g.last_ms, g.last_rn - g.first_rn + 1 AS members FROM g JOIN r ON {" AND ".join(f"g.{k} = r.{k}" for k in keys.split(", "))} AND r.rn = g.first_rn"""


@query(f"WITH {EVENTS_SQL}, f AS (SELECT * FROM ev WHERE status = 'failed'), {_episodes_sql('f', 'session_id', 3, 2 * DAY)}")
def retry_loop(spark, sf_dir):
    failed = events(spark, sf_dir).where("status = 'failed'")
    return sequences.episodes(failed, ["session_id"], 3, 2 * DAY).withColumn("members", F.col("members").cast("long"))


@query(f"""WITH {EVENTS_SQL} SELECT source_id, op_key, count(*) AS occurrences, count(DISTINCT session_id) AS sessions, CAST(sum(duration_ms) AS BIGINT) AS spent_ms FROM ev WHERE status = 'failed'
GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT session_id) >= 2""")
def repeated_error(spark, sf_dir):
    failed = events(spark, sf_dir).where("status = 'failed'")
    found = failed.groupBy("source_id", "op_key").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("session_id").alias("sessions"), F.sum("duration_ms").alias("spent_ms"))
    return found.where("occurrences >= 3 and sessions >= 2")


_EPOCHS = "z AS (SELECT *, CAST(op_key AS BIGINT) % 5 AS lookup, sum(CASE WHEN category = 'edit' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id) AS epoch FROM ev), f AS (SELECT id, session_id, CAST(epoch AS BIGINT) AS epoch, lookup, end_ms FROM z WHERE category IN ('read', 'search'))"


@query(f"WITH {EVENTS_SQL}, {_EPOCHS}, {_episodes_sql('f', 'session_id, epoch, lookup', 3, 3 * DAY)}")
def context_churn(spark, sf_dir):
    rows = events(spark, sf_dir).select("id", "session_id", "category", "end_ms", (F.col("op_key").cast("long") % 5).alias("lookup"))
    rows = blocks.running(rows, ["session_id"], "id", sums={"epoch": (F.col("category") == "edit").cast("long")})
    found = sequences.episodes(rows.where(F.col("category").isin("read", "search")), ["session_id", "epoch", "lookup"], 3, 3 * DAY)
    return found.withColumn("members", F.col("members").cast("long"))


@query(f"WITH {EVENTS_SQL}, f AS (SELECT * FROM ev WHERE category = 'validation'), {_episodes_sql('f', 'session_id', 3, DAY)}")
def validation_thrashing(spark, sf_dir):
    rows = events(spark, sf_dir).where("category = 'validation'")
    return sequences.episodes(rows, ["session_id"], 3, DAY).withColumn("members", F.col("members").cast("long"))


_W = 2 * DAY


@query(f"""WITH {EVENTS_SQL}, looks AS (SELECT session_id, CAST(op_key AS BIGINT) % 10 AS k, end_ms FROM ev WHERE category IN ('read', 'search')),
t AS (SELECT DISTINCT session_id, end_ms AS last_ms FROM looks),
c AS (SELECT session_id, last_ms, CAST(sum(n) AS BIGINT) AS lookups, max(n) AS most_same FROM (SELECT t.session_id, last_ms, k, count(*) AS n FROM t JOIN looks l ON l.session_id = t.session_id AND l.end_ms BETWEEN last_ms - {_W} AND last_ms GROUP BY ALL) GROUP BY ALL),
b AS (SELECT c.*, (SELECT count(*) FROM ev e WHERE e.session_id = c.session_id AND e.category = 'edit' AND e.start_ms <= c.last_ms AND e.end_ms >= c.last_ms - {_W}) AS barriers FROM c WHERE lookups >= 4 AND most_same >= 2)
SELECT session_id, last_ms, lookups, most_same FROM b WHERE barriers <= 1 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY last_ms) = 1""")
def exploration_window(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("k", F.col("op_key").cast("long") % 10)
    return sequences.window_search(rows, ["session_id"], F.col("category").isin("read", "search"), "k", F.col("category") == "edit", _W, 4, 2, 1)


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT *, CASE WHEN category = 'edit' THEN 'edit' WHEN category IN ('validation', 'command') THEN 'check' END AS step FROM ev WHERE category IN ('edit', 'validation', 'command')),
c AS (SELECT *, sum(CASE WHEN step = 'edit' AND (p IS NULL OR p <> 'edit') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id) AS cycle FROM (SELECT *, lag(step) OVER (PARTITION BY session_id ORDER BY id) AS p FROM v)),
f AS (SELECT session_id, cycle, arg_min(status, id) FILTER (step = 'check') AS first_status, count(*) FILTER (step = 'edit') AS edits, count(*) FILTER (step = 'check') AS checks FROM c WHERE cycle > 0 GROUP BY ALL)
SELECT session_id, count(*) AS cycles, CAST(sum(edits) AS BIGINT) AS edits, count(*) FILTER (checks > 0) AS validated, count(*) FILTER (first_status = 'completed') AS first_pass,
CASE WHEN count(*) FILTER (checks > 0) > 0 THEN count(*) FILTER (first_status = 'completed') / count(*) FILTER (checks > 0) END AS first_pass_share FROM f GROUP BY session_id""")
def edit_validation(spark, sf_dir):
    step = F.when(F.col("category") == "edit", "edit").when(F.col("category").isin("validation", "command"), "check")
    rows = events(spark, sf_dir).select("id", "session_id", "status", step.alias("step")).where("step is not null")
    rows = blocks.running(rows, ["session_id"], "id", previous={"before": "step"})
    begins = (F.col("step") == "edit") & F.coalesce(F.col("before") != "edit", F.lit(True))
    rows = blocks.running(rows, ["session_id"], "id", sums={"cycle": begins.cast("long")}).where("cycle > 0")
    cycles = rows.groupBy("session_id", "cycle").agg(F.min(F.when(F.col("step") == "check", F.struct("id", "status"))).alias("first"), F.count_if(F.col("step") == "edit").alias("edits"))
    out = cycles.groupBy("session_id").agg(F.count(F.lit(1)).alias("cycles"), F.sum("edits").alias("edits"), F.count("first").alias("validated"), F.count_if(F.col("first.status") == "completed").alias("first_pass"))
    return out.withColumn("first_pass_share", fraction(F.col("first_pass"), F.col("validated")))


@query(f"""WITH {EVENTS_SQL} SELECT id, session_id, max(CASE WHEN tool = 'signup' AND CAST(op_key AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id) = 1 AS ambiguous FROM ev""")
def ambiguity_propagation(spark, sf_dir):
    flag = (F.col("tool") == "signup") & (F.col("op_key").cast("long") % 10 == 0)
    return gates.propagate(events(spark, sf_dir), ["session_id"], flag, "id").select("id", "session_id", "ambiguous")


@query(f"WITH {EVENTS_SQL}, x AS (SELECT id, session_id, duration_ms, lag(duration_ms) OVER (PARTITION BY session_id ORDER BY id) AS before_ms FROM ev) SELECT id, session_id, before_ms, duration_ms FROM x WHERE duration_ms < before_ms")
def snapshot_reset(spark, sf_dir):
    rows = blocks.running(events(spark, sf_dir).select("id", "session_id", "duration_ms"), ["session_id"], "id", previous={"before_ms": "duration_ms"})
    return rows.where("duration_ms < before_ms").select("id", "session_id", "before_ms", "duration_ms")


@query("""SELECT c.conv_id, c.turn, a.turn AS reply_turn, length(c.text) AS asked, length(a.text) AS answered FROM conversations c
LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant' WHERE c.role = 'user'""")
def message_pairs(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"), (F.col("turn") + 1).alias("next"))
    replies = talk.where("role = 'assistant'").select(F.col("conv_id").alias("c"), F.col("turn").alias("reply_turn"), F.length("text").cast("long").alias("answered"))
    return asked.join(replies, (F.col("conv_id") == F.col("c")) & (F.col("next") == F.col("reply_turn")), "left").select("conv_id", "turn", "reply_turn", "asked", "answered")


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM status OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id) AS run FROM (SELECT *, lag(status) OVER (PARTITION BY session_id ORDER BY id) AS p FROM ev))
SELECT session_id, status, CAST(run AS BIGINT) AS run, count(*) AS n, min(id) AS first_id FROM x GROUP BY ALL HAVING count(*) >= 2""")
def status_runs(spark, sf_dir):
    rows = sequences.runs(events(spark, sf_dir), ["session_id"], ["status"])
    return rows.groupBy("session_id", "status", F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n >= 2")
