"""Cohorts, gates, reconciliation and views, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from traceloom.functions import expr, identity
from traceloom.operators import cohorts, gates, history
from traceloom.sources.driver_tables import EVENTS_SQL, USAGE_SQL, events, usage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_COHORT = """count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS sum_ms, CAST(sum(duration_ms) AS BIGINT) / count(*) AS mean_ms, max(duration_ms) AS max_ms,
CAST(quantile_disc(duration_ms, 0.5) AS BIGINT) AS p50_ms, CAST(quantile_disc(duration_ms, 0.95) AS BIGINT) AS p95_ms, count(*) < 20 AS low_sample"""


@query(f"WITH {EVENTS_SQL} SELECT session_id, category, tool, scope, {_COHORT} FROM ev GROUP BY ALL")
def duration_cohorts(spark, sf_dir):
    return cohorts.duration_cohorts(events(spark, sf_dir), ["session_id", "category", "tool", "scope"])


@query(f"WITH {EVENTS_SQL}, c AS (SELECT scope, category, session_id, {_COHORT} FROM ev GROUP BY ALL), r AS (SELECT scope, category, session_id, p95_ms, n, row_number() OVER (PARTITION BY scope ORDER BY p95_ms DESC, session_id, category) AS position, count(*) OVER (PARTITION BY scope) AS total FROM c) SELECT *, greatest(total - 6, 0) AS omitted FROM r WHERE position <= 6")
def latency_top(spark, sf_dir):
    found = cohorts.duration_cohorts(events(spark, sf_dir), ["scope", "category", "session_id"])
    top = cohorts.top_k(found, ["scope"], [F.desc("p95_ms"), F.col("session_id"), F.col("category")], 6)
    return top.select("scope", "category", "session_id", "p95_ms", "n", F.col("position").cast("long").alias("position"), "total", "omitted")


def _mix_sql(source: str, key: str, value: str, members: list[str], name: str = "member") -> str:
    spine = ", ".join(f"('{m}')" for m in members)
    return f"""k AS (SELECT DISTINCT {key} FROM {source}), m AS (SELECT * FROM (VALUES {spine}) AS t({name})),
x AS (SELECT k.{key}, m.{name}, (SELECT count(*) FROM {source} s WHERE s.{key} = k.{key} AND s.{value} = m.{name}) AS n FROM k, m)
SELECT {key}, {name}, n, CASE WHEN sum(n) OVER (PARTITION BY {key}) > 0 THEN n / sum(n) OVER (PARTITION BY {key}) END AS share FROM x"""


_STATUS = ["completed", "failed", "cancelled", "pending", "unknown"]


@query(f"WITH {EVENTS_SQL}, {_mix_sql('ev', 'session_id', 'status', _STATUS)}")
def status_mix(spark, sf_dir):
    return cohorts.mix(events(spark, sf_dir), ["session_id"], "status", _STATUS)


@query(f"WITH {EVENTS_SQL}, {_mix_sql('ev', 'session_id', 'scope', ['runtime', 'lifecycle', 'unknown'])}")
def scope_mix(spark, sf_dir):
    return cohorts.mix(events(spark, sf_dir), ["session_id"], "scope", ["runtime", "lifecycle", "unknown"])


_REASONS = ["not_terminal", "no_duration", "too_long"]
_WHY = "CASE WHEN tool = 'click' THEN 'not_terminal' WHEN duration_ms IS NULL OR duration_ms < 60000 THEN 'no_duration' WHEN duration_ms > 6000000 THEN 'too_long' ELSE 'eligible' END"


@query(f"WITH {EVENTS_SQL}, w AS (SELECT session_id, {_WHY} AS why FROM ev), {_mix_sql('w', 'session_id', 'why', ['eligible', *_REASONS], 'reason')}")
def exclusion_mix(spark, sf_dir):
    why = expr.first_reason((F.col("tool") == "click", "not_terminal"), (F.col("duration_ms").isNull() | (F.col("duration_ms") < 60000), "no_duration"), (F.col("duration_ms") > 6000000, "too_long"))
    return cohorts.exclusions(events(spark, sf_dir), ["session_id"], why, _REASONS)


@query("""WITH d AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, 0 AS copy FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END, 1 FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_custkey AS session_id, o_orderkey AS response_id, min(o_orderkey * 2 + copy) AS representative, count(*) AS copies, count(DISTINCT (o_totalprice, o_orderstatus)) > 1 AS conflicted FROM d GROUP BY ALL""")
def response_dedup(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("response_id"), "o_totalprice", "o_orderstatus")
    again = orders.where("response_id % 3 = 0").withColumn("o_orderstatus", F.when(F.col("response_id") % 10 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    both = orders.withColumn("copy", F.lit(0)).union(again.withColumn("copy", F.lit(1))).withColumn("id", F.col("response_id") * 2 + F.col("copy"))
    return cohorts.dedup_responses(both, ["session_id", "response_id"], "id", ["o_totalprice", "o_orderstatus"])


_PARTS = ["input", "cached_input", "output", "reasoning_output"]


def _sums(names: list[str]) -> str:
    return ", ".join(f"CASE WHEN count({c}) = count(*) THEN CAST(sum({c}) AS BIGINT) END AS {c}" for c in names)


@query(f"WITH {USAGE_SQL} SELECT response_id, count(*) AS n, {_sums(_PARTS)} FROM us GROUP BY response_id")
def component_sums(spark, sf_dir):
    return cohorts.component_sums(usage(spark, sf_dir), ["response_id"], _PARTS)


@query(f"""WITH {USAGE_SQL}, s AS (SELECT session_id, count(*) AS n, {_sums(_PARTS)} FROM us GROUP BY session_id)
SELECT session_id, n, CASE WHEN input > 0 AND cached_input <= input THEN cached_input / input END AS cache_share, CASE WHEN output > 0 AND reasoning_output <= output THEN reasoning_output / output END AS reasoning_share, output - reasoning_output AS visible_output FROM s""")
def token_shares(spark, sf_dir):
    sums = cohorts.component_sums(usage(spark, sf_dir), ["session_id"], _PARTS)
    return sums.select("session_id", "n", expr.fraction(F.col("cached_input"), F.col("input")).alias("cache_share"), expr.fraction(F.col("reasoning_output"), F.col("output")).alias("reasoning_share"), (F.col("output") - F.col("reasoning_output")).alias("visible_output"))


@query(f"""WITH {USAGE_SQL}, c AS (SELECT *, input + output + CASE WHEN line = 7 THEN 1 ELSE 0 END AS total FROM us)
SELECT CASE WHEN cached_input > input OR reasoning_output > output OR total <> input + output THEN 'invalid' ELSE 'valid' END AS count_status, count(*) AS n,
count(CASE WHEN NOT coalesce(total <> input + output, false) THEN total END) AS totals FROM c GROUP BY 1""")
def token_checks(spark, sf_dir):
    rows = usage(spark, sf_dir).withColumn("total", F.col("input") + F.col("output") + F.when(F.col("line") == 7, 1).otherwise(0))
    return gates.token_counts(rows).groupBy("count_status").agg(F.count(F.lit(1)).alias("n"), F.count("total").alias("totals"))


_FAIL = "count(*) FILTER (status IN ('completed', 'failed')) AS terminal, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'failed') / nullif(count(*) FILTER (status IN ('completed', 'failed')), 0) AS failed_share"


@query(f"WITH {EVENTS_SQL} SELECT session_id, {_FAIL} FROM ev GROUP BY ALL")
def failure_partitions(spark, sf_dir):
    return cohorts.failure_partitions(events(spark, sf_dir), ["session_id"])


@query(f"WITH {EVENTS_SQL} SELECT category, op_key, scope, {_FAIL} FROM ev GROUP BY ALL")
def failure_cohorts(spark, sf_dir):
    return cohorts.failure_partitions(events(spark, sf_dir), ["category", "op_key", "scope"])


_SLOW = """g AS (SELECT session_id, scope, tool, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS sum_ms, CAST(quantile_disc(duration_ms, 0.5) AS BIGINT) AS p50_ms, CAST(quantile_disc(duration_ms, 0.95) AS BIGINT) AS p95_ms FROM ev GROUP BY ALL),
t AS (SELECT *, CAST(sum(sum_ms) OVER (PARTITION BY session_id, scope) AS BIGINT) AS total_ms FROM g)"""


@query(f"WITH {EVENTS_SQL}, {_SLOW} SELECT *, sum_ms / total_ms AS share, row_number() OVER (PARTITION BY session_id, scope ORDER BY sum_ms DESC, n DESC, tool) AS rank FROM t WHERE n >= 5 AND total_ms > 0 AND sum_ms / total_ms >= 0.2")
def slow_tool(spark, sf_dir):
    return cohorts.slow_groups(events(spark, sf_dir), ["session_id", "scope"], ["tool"]).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT session_id, tool, CAST(sum(duration_ms) AS BIGINT) AS group_ms FROM ev GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY group_ms DESC, tool) AS group_rank, group_ms / sum(group_ms) OVER (PARTITION BY session_id) AS group_share FROM g),
c AS (SELECT session_id, tool, id, duration_ms, row_number() OVER (PARTITION BY session_id, tool ORDER BY duration_ms DESC, id) AS call_rank FROM ev)
SELECT c.session_id, c.tool, group_rank, group_ms, group_share, call_rank, id, duration_ms FROM c JOIN r ON c.session_id = r.session_id AND c.tool = r.tool WHERE call_rank <= 3""")
def command_breakdown(spark, sf_dir):
    out = cohorts.breakdown(events(spark, sf_dir), ["session_id"], "tool", 3)
    return out.withColumn("group_rank", F.col("group_rank").cast("long")).withColumn("call_rank", F.col("call_rank").cast("long"))


def _revisit_sql(category: str) -> str:
    return f"""WITH {EVENTS_SQL}, x AS (SELECT session_id, CASE WHEN CAST(op_key AS BIGINT) < 97 THEN op_key END AS k FROM ev WHERE category = '{category}'),
y AS (SELECT session_id, count(*) AS accesses, CASE WHEN count(k) = count(*) THEN count(DISTINCT k) END AS distinct_keys FROM x GROUP BY session_id)
SELECT *, (accesses - distinct_keys) / accesses AS repeat_share FROM y"""


def _revisits(spark, sf_dir, category: str):
    rows = events(spark, sf_dir).where(F.col("category") == category).withColumn("k", F.when(F.col("op_key").cast("long") < 97, F.col("op_key")))
    return cohorts.revisits(rows, ["session_id"], "k")


@query(_revisit_sql("read"))
def read_revisits(spark, sf_dir):
    return _revisits(spark, sf_dir, "read")


@query(_revisit_sql("search"))
def search_recurrence(spark, sf_dir):
    return _revisits(spark, sf_dir, "search")


@query(f"""WITH {USAGE_SQL}, o AS (SELECT response_id AS r, line AS l, input AS i, reasoning_output AS g, seen_ms AS t FROM us UNION ALL SELECT response_id, line, input, reasoning_output, seen_ms + 86400000 FROM us UNION ALL SELECT response_id, line, input + 1, reasoning_output, seen_ms - 86400000 FROM us),
f AS (SELECT us.*, (SELECT min(t) FROM o WHERE r = response_id AND l = line AND i IS NOT DISTINCT FROM input AND g IS NOT DISTINCT FROM reasoning_output) AS first_ms FROM us)
SELECT first_ms // 86400000 AS day, session_id, count(*) AS n, {_sums(_PARTS)} FROM f GROUP BY 1, 2""")
def usage_days(spark, sf_dir):
    rows = usage(spark, sf_dir).withColumn("key", F.col("response_id") * 10 + F.col("line"))
    seen = rows.select(F.col("key").alias("seen_key"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("more"), F.lit(0).cast("long").alias("late")), F.struct(F.lit(0).cast("long").alias("more"), F.lit(86400000).cast("long").alias("late")), F.struct(F.lit(1).cast("long").alias("more"), F.lit(-86400000).cast("long").alias("late")))).alias("o"), "input", "reasoning_output", "seen_ms")
    seen = seen.select("seen_key", (F.col("input") + F.col("o.more")).alias("seen_input"), F.col("reasoning_output").alias("seen_reasoning_output"), (F.col("seen_ms") + F.col("o.late")).alias("at_ms"))
    dated = history.usage_dates(rows.drop("seen_ms"), seen, "key", ["input", "reasoning_output"], "at_ms")
    return cohorts.component_sums(dated.withColumn("day", F.expr("first_seen_ms div 86400000")), ["day", "session_id"], _PARTS)


@query(f"WITH {EVENTS_SQL} SELECT session_id, count(*) FILTER (tool = 'view') AS views, count(*) FILTER (tool = 'purchase') AS purchases, CASE WHEN count(*) FILTER (tool = 'view') > 0 AND count(*) FILTER (tool = 'purchase') <= count(*) FILTER (tool = 'view') THEN count(*) FILTER (tool = 'purchase') / count(*) FILTER (tool = 'view') END AS share FROM ev GROUP BY session_id")
def evidence_fraction(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("tool") == "view").alias("views"), F.count_if(F.col("tool") == "purchase").alias("purchases"))
    return counts.withColumn("share", expr.fraction(F.col("purchases"), F.col("views")))


@query(f"WITH {EVENTS_SQL} SELECT session_id, count(*) AS executions FROM ev WHERE NOT EXISTS (SELECT 1 FROM ev w WHERE w.tool = 'signup' AND w.session_id = ev.session_id AND w.op_key = ev.op_key) GROUP BY session_id")
def wrapper_anti(spark, sf_dir):
    rows = events(spark, sf_dir)
    wrappers = rows.where("tool = 'signup'").select("session_id", "op_key")
    return rows.join(wrappers, ["session_id", "op_key"], "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("executions"))


@query("SELECT 'labels' AS side, count(*) AS n, count(*) FILTER (d.doc_id IS NULL) AS orphans FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 1000) d ON l.doc_id = d.doc_id")
def orphan_counts(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 1000").select("doc_id").distinct().withColumn("there", F.lit(True))
    return labels.join(docs, "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("there").isNull()).alias("orphans")).select(F.lit("labels").alias("side"), "n", "orphans")


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT DISTINCT session_id, op_key FROM ev WHERE id % 2 = 0), o AS (SELECT DISTINCT session_id, op_key FROM ev WHERE id % 3 = 0)
SELECT coalesce(p.session_id, o.session_id) AS session_id, count(*) FILTER (p.session_id IS NOT NULL AND o.session_id IS NOT NULL) AS kept, count(*) FILTER (p.session_id IS NULL) AS added, count(*) FILTER (o.session_id IS NULL) AS not_observed
FROM p FULL JOIN o ON p.session_id = o.session_id AND p.op_key = o.op_key GROUP BY 1""")
def membership_diff(spark, sf_dir):
    from traceloom.sources.snapshots import membership

    rows = events(spark, sf_dir).select("id", "session_id", "op_key")
    merged = membership(rows.where("id % 2 = 0").select("session_id", "op_key").distinct(), rows.where("id % 3 = 0").select("session_id", "op_key").distinct(), ["session_id", "op_key"])
    return merged.groupBy("session_id").agg(F.count_if(F.col("state") == "kept").alias("kept"), F.count_if(F.col("state") == "added").alias("added"), F.count_if(F.col("state") == "not_observed").alias("not_observed"))


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT id, session_id, category, id % 101 <> 0 AS ok FROM ev), x AS (SELECT *, bool_or(NOT ok) OVER (PARTITION BY session_id, category) AS poisoned FROM b)
SELECT session_id, category, poisoned, count(*) AS n FROM x GROUP BY ALL""")
def poisoned_partitions(spark, sf_dir):
    rows = gates.poisoned(events(spark, sf_dir), ["session_id", "category"], F.col("id") % 101 != 0)
    return rows.groupBy("session_id", "category", "poisoned").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT session_id AS source_id, count(*) AS n, count(*) FILTER (tool = 'purchase') AS evidence FROM ev GROUP BY 1),
a AS (SELECT DISTINCT session_id FROM ev WHERE tool = 'error' AND CAST(op_key AS BIGINT) < 3)
SELECT source_id, n, CASE WHEN source_id % 17 = 0 THEN 'source_unavailable' WHEN evidence = 0 THEN 'evidence_absent' WHEN n > 90 THEN 'state_limited' WHEN source_id IN (SELECT session_id FROM a) THEN 'ambiguous_origin' END AS suppressed FROM s""")
def suppression_reasons(spark, sf_dir):
    rows = events(spark, sf_dir)
    sources = rows.groupBy(F.col("session_id").alias("source_id")).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("tool") == "purchase") > 0).alias("has_evidence"))
    sources = sources.withColumn("availability", F.when(F.col("source_id") % 17 == 0, "unavailable").otherwise("available")).withColumn("state_limited", F.col("n") > 90)
    origin = F.when((F.col("tool") == "error") & (F.col("op_key").cast("long") < 3), "ambiguous").otherwise("root")
    return gates.suppression(sources, rows.select(F.col("session_id").alias("source_id"), origin.alias("origin"))).select("source_id", "n", "suppressed")


_KEY = hashlib.sha256(b"traceloom test key").digest()
_PAD = [bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT DISTINCT tool, op_key, '["tool","' || tool || '","' || op_key || '"]' AS t FROM ev)
SELECT tool, op_key, 'h1:k1:tool:' || sha256(from_hex('{_PAD[1]}') || from_hex(sha256(from_hex('{_PAD[0]}') || encode(t)))) AS fingerprint FROM m""")
def fingerprints(spark, sf_dir):
    rows = events(spark, sf_dir).select("tool", "op_key").distinct()
    return rows.withColumn("fingerprint", identity.fingerprint(_KEY, "k1", "tool", F.col("tool"), F.col("op_key")))


@query(None)
def command_classes(spark, sf_dir):
    """Each line of a conversation as a command: its pattern, category and exit policy."""
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "command"))
    return lines.withColumn("c", identity.command_class("command")).select("conv_id", "turn", "line", "c.pattern", "c.category", "c.policy", "c.plain")


@query("""SELECT '{"k":' || (props->>'$.k') || '}' AS canonical, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1""")
def canonical_props(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", identity.canonical_json("props").alias("canonical"))
    return rows.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT session_id, tool, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS known_ms FROM ev GROUP BY ALL)
SELECT session_id, tool, n, known_ms, row_number() OVER (PARTITION BY session_id ORDER BY known_ms DESC NULLS LAST, tool) AS position, '["' || tool || '"]' AS sort_key FROM g""")
def time_breakdown(spark, sf_dir):
    from pyspark.sql.window import Window as W

    sums = events(spark, sf_dir).groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("known_ms"))
    ranked = sums.withColumn("position", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc_nulls_last("known_ms"), "tool")).cast("long"))
    return ranked.withColumn("sort_key", expr.key_text(F.col("tool")))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT session_id, count(*) AS n, count(*) FILTER (duration_ms >= 60000) AS timed, count(DISTINCT tool) AS tools, count(DISTINCT op_key) AS keys FROM ev GROUP BY 1)
SELECT 'inventory' AS view, session_id, CASE WHEN n > 0 THEN 'evaluated' ELSE 'suppressed' END AS state, n, timed, tools, keys, timed / n AS timed_share FROM s""")
def evidence_views(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("duration_ms") >= 60000).alias("timed"), F.countDistinct("tool").alias("tools"), F.countDistinct("op_key").alias("keys"))
    return s.select(F.lit("inventory").alias("view"), "session_id", F.when(F.col("n") > 0, "evaluated").otherwise("suppressed").alias("state"), "n", "timed", "tools", "keys", expr.fraction(F.col("timed"), F.col("n")).alias("timed_share"))
