"""Operations, turns, usage by day, scans and timelines over chosen sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.functions.saved import saved
from traceloom.operators import history, intervals, native, selected
from traceloom.plans import native_queries
from traceloom.plans.interval_queries import DAY, FROM_MS, TO_MS, islands_sql
from traceloom.plans.native_queries import _ADMITTED, _POSITIONS
from traceloom.sources.agent_tables import AGENT_SQL, executions, observations, sources
from traceloom.sources.driver_tables import EVENTS_SQL, USAGE_SQL, events, usage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# Sessions are cut by turn and shell calls share a class, so that operations are tried again. Spark and DuckDB read these alike.
_SESSION = "session_id * 7 + id % 7"
_CATEGORY = "CASE WHEN kind = 'shell' AND id % 307 <> 11 THEN 'test' ELSE category END"
_OPERATION = "CASE WHEN id % 1409 <> 9 THEN kind END"
_SEEN = "o_session * 7 + abs(event_id) % 7"


def _retried(spark, sf_dir):
    """Attempts of all executions, admitted by their finer sessions."""
    rows = executions(spark, sf_dir).withColumns({"session_id": F.expr(_SESSION), "category": F.expr(_CATEGORY), "op_key": F.expr(_OPERATION)})
    seen = observations(spark, sf_dir).withColumn("o_session", F.expr(_SEEN))
    return saved(selected.attempts(native.admission(rows, seen, native_queries._suppressed(spark, sf_dir)), seen))


_FINER = AGENT_SQL.replace("ag AS (SELECT", "ag_ AS (SELECT", 1).replace("FROM ag WHERE", "FROM ag_ WHERE").replace("ob AS (", "ob_ AS (", 1).replace("FROM ag))", "FROM ag_))", 1) + f""",
ag AS (SELECT * REPLACE ({_SESSION} AS session_id, {_CATEGORY} AS category, {_OPERATION} AS op_key) FROM ag_), ob AS (SELECT * REPLACE ({_SEEN} AS o_session) FROM ob_)"""
_OPERATIONS = f"""{_ADMITTED},
tr AS (SELECT *, coalesce(interval_scope = 'item_lifecycle' AND interval_evidence = 'source_reported' AND record_type = 'event_msg', false) AS st, coalesce(interval_scope = 'invocation_latency' AND interval_evidence = 'paired_timestamps' AND record_type = 'response_item', false) AS pa
  FROM ad WHERE (kind, tool_name) IN (('shell', 'exec_command'), ('mcp', 'mcp'))),
ev2 AS (SELECT t.id, o_turn IS NOT DISTINCT FROM turn_id AS same, o_turn, st, pa, origin = 'ordinary' AS plain, pa AND representation = 'call' AND o_at < byte_offset AS is_call, o_at = byte_offset AND CASE WHEN st THEN representation = 'structured' ELSE representation IN ('result', 'poll') END AS is_end
  FROM tr t JOIN ob o ON o.event_id = t.id AND o.source_id = t.source_id AND o_file = file_id WHERE representation <> 'wrapper'),
pf AS (SELECT id, bool_or(plain AND NOT same AND (is_call OR (is_end AND (st OR o_turn IS NOT NULL)))) AS bad, bool_or(plain AND is_end) AS has_end, bool_or(plain AND is_call AND same) AS has_call, bool_or(is_call) AS any_call FROM ev2 GROUP BY id),
lack AS (SELECT t.id, CASE WHEN start_ms IS NULL OR end_ms IS NULL THEN ['missing_boundaries'] WHEN end_ms < start_ms THEN ['invalid_boundaries'] WHEN NOT st AND NOT pa THEN ['unsupported_interval'] ELSE list_filter([CASE WHEN bad THEN 'contradictory_turn_proof' END, CASE WHEN NOT coalesce(has_end, false) THEN 'missing_terminal_proof' END,
  CASE WHEN pa AND NOT coalesce(has_call, false) THEN CASE WHEN any_call THEN 'missing_turn_proof' ELSE 'missing_call_before_result' END END], lambda x: x IS NOT NULL) END AS why FROM tr t LEFT JOIN pf USING (id) WHERE admitted),
kn AS (SELECT tr.*, why, coalesce(admitted AND len(why) = 0, false) AS placed FROM tr LEFT JOIN lack USING (id) WHERE op_key IS NOT NULL AND turn_id IS NOT NULL),
nx AS (SELECT a.*, b.byte_offset AS b_at, b.start_ms AS b_start, b.end_ms AS b_end, a.placed AND b.placed AS two FROM (SELECT *, lag(id) OVER w AS prev FROM kn WINDOW w AS (PARTITION BY source_id, session_id, turn_id, op_key ORDER BY byte_offset, id)) a LEFT JOIN kn b ON b.id = a.prev),
rs AS (SELECT source_id, session_id, turn_id, op_key, unnest(why) AS reason FROM kn WHERE why IS NOT NULL
  UNION SELECT source_id, session_id, turn_id, op_key, unnest([CASE WHEN NOT admitted THEN 'terminal_not_admitted' END, CASE status WHEN 'pending' THEN 'pending_attempt' WHEN 'cancelled' THEN 'cancelled_attempt' WHEN 'unknown' THEN 'unknown_status' ELSE CASE WHEN NOT ((status = 'failed' AND outcome = 'error') OR (status = 'completed' AND outcome = 'success')) THEN 'unconfirmed_outcome' END END,
    CASE WHEN byte_offset = b_at THEN 'ambiguous_source_order' END, CASE WHEN two AND (start_ms = b_start OR end_ms = b_end) THEN 'tied_boundaries' END, CASE WHEN two AND (start_ms < b_start OR end_ms < b_end) THEN 'source_time_order_conflict' END, CASE WHEN two AND start_ms < b_end THEN 'overlapping_attempts' END]) FROM nx
  UNION SELECT source_id, session_id, turn_id, op_key, 'operation_class_conflict' FROM kn GROUP BY ALL HAVING count(DISTINCT (kind, category, tool_name)) > 1
  UNION SELECT source_id, session_id, turn_id, op_key, 'mixed_interval_evidence' FROM kn WHERE placed GROUP BY ALL HAVING count(DISTINCT (interval_scope, interval_evidence)) > 1
  UNION SELECT source_id, session_id, turn_id, op_key, 'inconsistent_source_file' FROM kn GROUP BY ALL HAVING count(DISTINCT file_id) > 1
  UNION SELECT source_id, session_id, turn_id, op_key, 'session_unavailable' FROM kn SEMI JOIN (SELECT source_id, session_id FROM tr WHERE suppressed IS NOT NULL OR provider <> 'codex' OR partition_status = 'provenance_unresolved' OR op_key IS NULL OR turn_id IS NULL) q USING (source_id, session_id)),
og AS (SELECT k.*, coalesce(r.reasons, '') AS reasons FROM (SELECT source_id, session_id, turn_id, op_key, count(*) AS attempts, count(*) FILTER (admitted AND status = 'failed' AND outcome = 'error') AS known_failed FROM kn GROUP BY ALL) k
  LEFT JOIN (SELECT source_id, session_id, turn_id, op_key, string_agg(reason, ',' ORDER BY reason) AS reasons FROM rs WHERE reason IS NOT NULL GROUP BY ALL) r USING (source_id, session_id, turn_id, op_key))"""


@query(f"WITH {_FINER}, {_OPERATIONS} SELECT * FROM og")
def retried_operations(spark, sf_dir):
    """Operations of a turn, and why the order of their attempts can't be told."""
    return selected.operations(_retried(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {_FINER}, {_OPERATIONS}, c AS (SELECT kn.*, coalesce(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, session_id, turn_id, op_key ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain
  FROM kn SEMI JOIN (FROM og WHERE reasons = '') g USING (source_id, session_id, turn_id, op_key))
SELECT source_id, session_id, turn_id, op_key, CAST(chain AS BIGINT) AS chain, count(*) FILTER (status = 'failed') AS failures, bool_or(status = 'completed') AS resolved,
CASE WHEN bool_or(status = 'completed') THEN max(end_ms) FILTER (status = 'completed') - min(end_ms) FILTER (status = 'failed') END AS elapsed_ms FROM c GROUP BY ALL HAVING count(*) FILTER (status = 'failed') > 0""")
def operation_recovery(spark, sf_dir):
    """Chains of proven failures up to the success that ends them."""
    tried = _retried(spark, sf_dir)
    return selected.operation_chains(tried, selected.operations(tried))


_RETRIES = f"""{_OPERATIONS}, c AS (SELECT kn.*, coalesce(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, session_id, turn_id, op_key ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain FROM kn SEMI JOIN (FROM og WHERE reasons = '') g USING (source_id, session_id, turn_id, op_key)),
f AS (SELECT *, CASE WHEN duration_ms IS NULL THEN 'missing_duration' WHEN duration_ms < 0 THEN 'invalid_duration' WHEN duration_scope = 'unknown' THEN 'unknown_scope' WHEN timing_evidence = 'estimated' THEN 'estimated_timing' WHEN timing_evidence = 'unknown' THEN 'unknown_timing'
  WHEN timing_evidence = 'source_reported' AND NOT (record_type = 'event_msg' AND ((kind = 'shell' AND duration_scope = 'process_runtime') OR (kind = 'mcp' AND duration_scope = 'invocation_latency'))) THEN 'unsupported_timing_representation'
  WHEN timing_evidence = 'paired_timestamps' AND NOT (duration_scope = 'invocation_latency' AND record_type = 'response_item') THEN 'unsupported_timing_representation' WHEN timing_evidence = 'paired_timestamps' AND end_ms - start_ms <> duration_ms THEN 'missing_timing_provenance' END AS why2 FROM c WHERE status = 'failed')"""


@query(f"""WITH {_FINER}, {_RETRIES}, {islands_sql('f', 'source_id, session_id, turn_id, op_key, chain')}, u AS (SELECT source_id, session_id, turn_id, op_key, chain, CAST(sum(hi - lo) AS BIGINT) AS retry_overhead_ms FROM isl GROUP BY ALL),
d AS (SELECT source_id, session_id, turn_id, op_key, chain, count(*) AS failed_n, count(*) FILTER (why2 IS NULL) AS measured_n, CAST(sum(duration_ms) FILTER (why2 IS NULL) AS BIGINT) AS s, count(DISTINCT (duration_scope, timing_evidence)) FILTER (why2 IS NULL) AS kinds FROM f GROUP BY ALL)
SELECT source_id, session_id, turn_id, op_key, CAST(chain AS BIGINT) AS chain, failed_n, measured_n, CASE WHEN measured_n = failed_n AND kinds <= 1 THEN s END AS duration_sum_ms, CASE WHEN measured_n < failed_n THEN 'incomplete_duration_coverage' WHEN kinds > 1 THEN 'incompatible_duration_cohorts' END AS duration_reason, retry_overhead_ms FROM d JOIN u USING (source_id, session_id, turn_id, op_key, chain)""")
def retry_chains(spark, sf_dir):
    """What the failed attempts of each proven chain took."""
    tried = _retried(spark, sf_dir)
    return selected.retry_chains(saved(selected.retry_attempts(tried, selected.operations(tried))))


@query(f"""WITH {_FINER}, {_RETRIES}, {islands_sql('f', 'source_id, session_id, interval_scope, interval_evidence')}, u AS (SELECT source_id, count(*) AS parts, min(ms) AS ms FROM (SELECT source_id, session_id, interval_scope, interval_evidence, CAST(sum(hi - lo) AS BIGINT) AS ms FROM isl GROUP BY ALL) GROUP BY source_id),
d AS (SELECT source_id, count(DISTINCT (session_id, turn_id, op_key, chain)) AS chain_n, count(*) AS failed_n, count(*) FILTER (why2 IS NULL) AS measured_n, CAST(sum(duration_ms) FILTER (why2 IS NULL) AS BIGINT) AS s, count(DISTINCT (session_id, duration_scope, timing_evidence)) FILTER (why2 IS NULL) AS kinds FROM f GROUP BY ALL),
o AS (SELECT source_id, suppressed IS NULL AND provider = 'codex' AS ok, coalesce(chain_n, 0) AS chain_n, coalesce(failed_n, 0) AS failed_n, coalesce(measured_n, 0) AS measured_n, s, kinds, coalesce(parts, 0) AS parts, ms FROM so JOIN sup USING (source_id) LEFT JOIN d USING (source_id) LEFT JOIN u USING (source_id))
SELECT source_id, CASE WHEN ok THEN chain_n END AS chain_n, CASE WHEN ok THEN failed_n END AS failed_n, CASE WHEN ok THEN measured_n END AS measured_n, CASE WHEN ok AND failed_n = 0 THEN 0 WHEN ok AND measured_n = failed_n AND kinds <= 1 THEN s END AS duration_sum_ms,
CASE WHEN NOT ok THEN 'recovery_unavailable' WHEN measured_n < failed_n THEN 'incomplete_duration_coverage' WHEN kinds > 1 THEN 'incompatible_duration_cohorts' END AS duration_reason, CASE WHEN ok AND parts <= 1 THEN coalesce(ms, 0) END AS retry_overhead_ms, CASE WHEN NOT ok THEN 'recovery_unavailable' WHEN parts > 1 THEN 'incompatible_interval_partitions' END AS retry_overhead_reason FROM o""")
def retry_overhead_sources(spark, sf_dir):
    """Time that failed attempts of proven chains took, where it has one meaning in a source."""
    tried = _retried(spark, sf_dir)
    usable = native_queries._suppressed(spark, sf_dir).join(sources(spark, sf_dir).select("source_id", F.col("provider").alias("_p")), "source_id").select("source_id", (F.col("suppressed").isNull() & (F.col("_p") == "codex")).alias("usable"))
    return selected.retry_overhead(tried, selected.operations(tried), usable)


_TURN = {
    "source_id": "session_id % 50", "provider": "CASE WHEN session_id % 2 = 0 THEN 'codex' ELSE 'claude' END", "status": "CASE WHEN id % 17 = 0 THEN 'pending' WHEN id % 19 = 0 THEN 'failed' WHEN id % 5 = 0 THEN 'cancelled' ELSE 'completed' END",
    "scope": "CASE WHEN id % 53 = 1 THEN 'unknown' WHEN session_id % 4 = 0 THEN 'turn_wall' ELSE 'observed_turn' END", "evidence": "CASE WHEN id % 59 = 2 THEN 'estimated' WHEN (session_id % 4 = 0) <> (id % 43 = 2) THEN 'source_reported' ELSE 'paired_timestamps' END",
    "file_id": "CASE WHEN id % 71 = 6 THEN session_id % 50 + 1000 ELSE session_id % 50 END", "byte_offset": "id * 10 + 5", "start_ms": "CASE WHEN id % 61 <> 3 THEN start_raw END", "end_ms": "CASE WHEN id % 67 = 4 THEN start_raw - 1 ELSE end_raw END",
}
_TURN_SEEN = [("'pending'", "id * 10", "id % 29 <> 3"), ("status", "id * 10 + 5", "id % 31 <> 4 AND status <> 'pending'"), ("'failed'", "id * 10 + 7", "id % 37 = 5")]
_TURN_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in _TURN.items())
_TURN_PART = "SELECT source_id, id AS turn_id, CASE WHEN id % 41 = 6 THEN 'ambiguous' ELSE 'ordinary' END AS origin, {} AS o_status, source_id AS o_file, {} AS o_at FROM {} WHERE {}"


def _turns(spark, sf_dir):
    """A turn for each session and 500 events, and what the logs say about it."""
    raw = events(spark, sf_dir).groupBy("session_id", "turn_id").agg(F.min("id").alias("id"), F.min("start_ms").alias("start_raw"), F.max("end_ms").alias("end_raw"))
    turns = raw.selectExpr("session_id", "id", *[f"{e} AS {n}" for n, e in _TURN.items()])
    seen = None
    for status, at, where in _TURN_SEEN:
        part = turns.where(where).selectExpr("source_id", "id AS turn_id", "CASE WHEN id % 41 = 6 THEN 'ambiguous' ELSE 'ordinary' END AS origin", f"{status} AS o_status", "source_id AS o_file", f"{at} AS o_at")
        seen = part if seen is None else seen.unionByName(part)
    return selected.turn_reasons(turns, seen)


_TURNS = f"""WITH {EVENTS_SQL}, raw AS (SELECT session_id, turn_id, min(id) AS id, min(start_ms) AS start_raw, max(end_ms) AS end_raw FROM ev GROUP BY ALL), tu AS (SELECT session_id, id, {_TURN_COLUMNS} FROM raw),
ts AS ({' UNION ALL '.join(_TURN_PART.format(s, a, 'tu', w) for s, a, w in _TURN_SEEN)}),
term AS (SELECT tu.id, o_status, o_at, origin = 'ordinary' AND o_file = file_id AS own FROM tu JOIN ts ON ts.turn_id = tu.id WHERE o_status <> 'pending'),
ft AS (SELECT id, min(o_at) AS first_at FROM term WHERE own GROUP BY id),
tp AS (SELECT tu.*, CASE WHEN provider <> 'codex' THEN 'unsupported_provider' WHEN status = 'pending' THEN 'pending' WHEN status = 'failed' THEN 'unknown_status' WHEN start_ms IS NULL OR end_ms IS NULL THEN 'missing_boundaries' WHEN evidence = 'estimated' THEN 'estimated_timing' WHEN scope = 'unknown' THEN 'unknown_interval'
  WHEN NOT ((scope = 'turn_wall' AND evidence = 'source_reported') OR (scope = 'observed_turn' AND evidence = 'paired_timestamps')) THEN 'inconsistent_interval' WHEN end_ms < start_ms THEN 'invalid_boundaries'
  WHEN EXISTS (FROM term WHERE term.id = tu.id AND o_status <> status) THEN 'contradictory_terminal_proof' WHEN NOT EXISTS (FROM term WHERE term.id = tu.id AND own AND o_at = byte_offset) THEN 'missing_terminal_proof'
  WHEN scope = 'observed_turn' AND NOT EXISTS (FROM ts WHERE ts.turn_id = tu.id AND o_status = 'pending' AND origin = 'ordinary' AND o_file = file_id AND o_at < first_at) THEN 'missing_pending_proof' END AS reason FROM tu LEFT JOIN ft USING (id))"""


@query(f"{_TURNS} SELECT source_id, coalesce(reason, 'eligible') AS reason, count(*) AS n FROM tp GROUP BY ALL")
def turn_exclusions(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("source_id", F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_TURNS}, el AS (SELECT * FROM tp WHERE reason IS NULL), {islands_sql('el', 'session_id, scope, evidence')}
SELECT session_id, scope, evidence, CAST(sum(members) AS BIGINT) AS turns, CAST(sum(hi - lo) AS BIGINT) AS active_ms, max(hi) - min(lo) AS span_ms FROM isl GROUP BY ALL""")
def proven_active_time(spark, sf_dir):
    found = intervals.union_length(_turns(spark, sf_dir).where("reason IS NULL"), ["session_id", "scope", "evidence"])
    return found.select("session_id", "scope", "evidence", F.col("n").alias("turns"), F.col("union_ms").alias("active_ms"), "span_ms")


_COUNTS = ["input", "cached_input", "output", "reasoning_output"]
_COPY = {
    "response": "CASE WHEN usage_id % 101 <> 1 THEN usage_id END", "scope": "CASE WHEN usage_id % 10 = 6 THEN 'cumulative' ELSE 'response' END", "finality": "CASE WHEN usage_id % 11 = 0 THEN 'streaming' ELSE 'source_terminal' END",
    "selection": "CASE WHEN usage_id % 11 = 0 THEN 'provisional' WHEN usage_id % 13 = 0 THEN 'conflicted' WHEN usage_id % 17 = 0 THEN 'invalid' WHEN usage_id % 19 = 0 THEN 'unverified' ELSE 'eligible' END",
}
_SEEN_USAGE = [
    ("0", "CASE WHEN usage_id % 29 = 0 THEN 'ambiguous' ELSE 'ordinary' END", "finality", "CASE WHEN usage_id % 5 <> 0 THEN seen_ms + source_id END", "usage_id % 31 <> 0"),
    ("1", "'ordinary'", "CASE WHEN usage_id % 46 = 0 THEN 'source_terminal' ELSE 'streaming' END", "seen_ms - 1000", "usage_id % 23 = 0"),
]
_US_FROM, _US_TO = 820_454_400_000, 852_076_800_000


def _usage_history(spark, sf_dir):
    """Each order line is a response, which two sources hold if its order is even."""
    base = usage(spark, sf_dir).withColumn("usage_id", F.expr("response_id * 10 + line")).withColumn("source_id", F.explode(F.expr("CASE WHEN response_id % 2 = 0 THEN array(1L, 2L) ELSE array(1L) END")))
    base = base.withColumn("input", F.expr("input + CASE WHEN source_id = 2 AND usage_id % 7 = 0 THEN 1 ELSE 0 END"))
    copies = base.selectExpr("source_id", "usage_id", "session_id", *[f"{e} AS {'response_id' if n == 'response' else n}" for n, e in _COPY.items()], *_COUNTS, "seen_ms")
    seen = None
    for more, origin, finality, at, where in _SEEN_USAGE:
        part = copies.where(where).selectExpr("source_id", "usage_id", f"{origin} AS origin", f"{finality} AS o_finality", f"input + {more} AS o_input", *[f"{c} AS o_{c}" for c in _COUNTS[1:]], f"{at} AS seen_ms")
        seen = part if seen is None else seen.unionByName(part)
    return selected.usage_history(copies.drop("seen_ms"), seen, _COUNTS, _US_FROM, _US_TO)


_RESPONSES = f"""WITH {USAGE_SQL}, b AS (SELECT * REPLACE (input + CASE WHEN source_id = 2 AND (response_id * 10 + line) % 7 = 0 THEN 1 ELSE 0 END AS input), response_id * 10 + line AS usage_id FROM (SELECT *, unnest(CASE WHEN response_id % 2 = 0 THEN [1, 2] ELSE [1] END) AS source_id FROM us)),
cp AS (SELECT source_id, usage_id, session_id, {', '.join(f'{e} AS {n}' for n, e in _COPY.items())}, {', '.join(_COUNTS)}, seen_ms FROM b),
so2 AS ({' UNION ALL '.join(f"SELECT source_id, usage_id, {o} AS origin, {f} AS o_finality, (input + {m}, cached_input, output, reasoning_output) AS told, {a} AS at_ms FROM cp WHERE {w}" for m, o, f, a, w in _SEEN_USAGE)}),
mt AS (SELECT cp.session_id, cp.usage_id, o_finality, at_ms, told IS NOT DISTINCT FROM (input, cached_input, output, reasoning_output) AND o_finality = finality AS fits FROM cp JOIN so2 USING (source_id, usage_id) WHERE origin = 'ordinary' AND scope = 'response' AND response IS NOT NULL),
mg AS (SELECT session_id, usage_id AS response_id, min(at_ms) FILTER (fits) AS seen, bool_or(fits) AS proven, bool_or(NOT fits AND o_finality = 'source_terminal') AS against FROM mt GROUP BY ALL),
gr AS (SELECT session_id, response AS response_id, count(DISTINCT source_id) AS copies, count(DISTINCT (selection, finality, {', '.join(_COUNTS)})) > 1 AS differ, min(selection) AS sel, {', '.join(f'min({c}) AS {c}' for c in _COUNTS)} FROM cp WHERE scope = 'response' AND response IS NOT NULL GROUP BY ALL),
jg AS (SELECT gr.*, seen, coalesce(proven, false) AS proven, coalesce(against, false) AS against FROM gr LEFT JOIN mg USING (session_id, response_id)),
rn AS (SELECT *, CASE WHEN differ THEN 'response_conflict' WHEN sel IN ('invalid', 'conflicted') THEN sel WHEN sel = 'unverified' THEN 'unverified_selection' WHEN against THEN 'terminal_observation_conflict' WHEN NOT proven THEN 'missing_usage_proof' END AS reason FROM jg),
rp AS (SELECT session_id, response_id, copies, reason, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN seen IS NULL THEN 'undated' WHEN seen < {_US_FROM} OR seen >= {_US_TO} THEN 'outside_window' ELSE 'dated' END AS state,
  CASE WHEN reason IS NULL THEN CASE sel WHEN 'eligible' THEN 'final' ELSE 'provisional' END END AS selection, CASE WHEN reason IS NULL THEN seen END AS first_seen_ms, {', '.join(f'CASE WHEN reason IS NULL THEN {c} END AS {c}' for c in _COUNTS)} FROM rn)"""


@query(f"{_RESPONSES} SELECT state, coalesce(reason, '') AS reason, coalesce(selection, '') AS selection, count(*) AS responses, CAST(sum(copies) AS BIGINT) AS copies FROM rp GROUP BY ALL")
def usage_history_states(spark, sf_dir):
    none = F.lit("")
    return _usage_history(spark, sf_dir).groupBy("state", F.coalesce("reason", none).alias("reason"), F.coalesce("selection", none).alias("selection")).agg(F.count(F.lit(1)).alias("responses"), F.sum("copies").alias("copies"))


@query(f"""{_RESPONSES} SELECT (first_seen_ms + 19800000) // {DAY} AS day, session_id, selection, count(*) AS responses, {', '.join(f'CASE WHEN count({c}) = count(*) THEN CAST(sum({c}) AS BIGINT) END AS {c}' for c in _COUNTS)} FROM rp WHERE state = 'dated' GROUP BY ALL""")
def usage_history_days(spark, sf_dir):
    return selected.usage_history_days(_usage_history(spark, sf_dir), _COUNTS, history.parse_offset("+05:30"))


_LISTED = {"path": "concat('p', lpad(CAST(session_id AS {text}), 12, '0'))", "source_id": "session_id", "digest": "total", "rejected": "session_id % 29 = 5"}
_STORED = {"source_id": "session_id", "expected": "1 + session_id % 5", "actual": "1 + session_id % 5 + CASE WHEN session_id % 31 = 6 THEN 1 ELSE 0 END", "stored_digest": "total + CASE WHEN session_id % 7 = 1 THEN 1 ELSE 0 END", "current": "session_id % 11 <> 2 AND session_id % 13 <> 3"}


@query(f"""WITH {EVENTS_SQL}, fi AS (SELECT session_id, CAST(sum(id) AS BIGINT) AS total FROM ev GROUP BY ALL), st AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _STORED.items())} FROM fi WHERE session_id % 3 <> 0),
x AS (SELECT f.session_id AS source_id, CASE WHEN coalesce(current AND total = stored_digest, false) THEN CASE WHEN actual <> expected THEN 'stale' ELSE 'unchanged' END WHEN session_id % 29 = 5 THEN 'rejected' WHEN actual <> expected THEN 'stale' ELSE 'committed' END AS status,
  expected, 1 + CASE WHEN session_id % 17 = 4 THEN 1 ELSE 0 END AS listings, (row_number() OVER (ORDER BY session_id) - 1) // 16 AS page FROM fi f LEFT JOIN st ON st.source_id = f.session_id)
SELECT source_id, status, CASE WHEN status = 'unchanged' THEN expected END AS reused, CASE WHEN status = 'committed' THEN coalesce(expected, 0) + 1 END AS revision, CAST(listings AS BIGINT) AS listings, page <= coalesce((SELECT min(page) FROM x WHERE status NOT IN ('committed', 'unchanged')), page) AS in_pages FROM x""")
def scan_outcomes(spark, sf_dir):
    """Each session's log as a source that a scan meets again: some are new, some changed, some equal, some broken."""
    files = events(spark, sf_dir).groupBy("session_id").agg(F.sum("id").alias("total"))
    listed = files.selectExpr(*[f"{e.format(text='string')} AS {n}" for n, e in _LISTED.items()])
    stored = files.where("session_id % 3 <> 0").selectExpr(*[f"{e} AS {n}" for n, e in _STORED.items()])
    return selected.scan_outcomes(listed.unionByName(listed.where("source_id % 17 = 4")), stored)


@query(f"""WITH {AGENT_SQL}, {_ADMITTED}, {_POSITIONS}, r AS (SELECT ad.*, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, id) AS position FROM ad JOIN (SELECT id FROM po WHERE position_reason IS NULL) USING (id) WHERE admitted)
SELECT source_id, position, id, session_id, category, status, start_ms, end_ms, interval_scope, interval_evidence FROM r WHERE position <= 48""")
def source_timeline(spark, sf_dir):
    """The first 48 placed executions of each source, as the report shows them."""
    placed = native.positions(native_queries._admitted(spark, sf_dir), observations(spark, sf_dir)).where("admitted AND position_reason IS NULL")
    order = F.row_number().over(W.partitionBy("source_id").orderBy("start_ms", "end_ms", "id"))
    return placed.withColumn("position", order).where("position <= 48").select("source_id", F.col("position").cast("long").alias("position"), "id", "session_id", "category", "status", "start_ms", "end_ms", "interval_scope", "interval_evidence")


_HISTORY = f"""{_ADMITTED}, {_POSITIONS}, sel AS (SELECT ad.* FROM ad JOIN (SELECT id FROM po WHERE position_reason IS NULL) USING (id) WHERE admitted)"""


def _history(spark, sf_dir):
    """Executions whose copies agree: a second source holds each third one, sometimes with another status or no place."""
    first = native.positions(native_queries._admitted(spark, sf_dir), observations(spark, sf_dir))
    placed = F.col("position_reason").isNull()
    first = first.withColumns({c: F.when(placed, F.col(c)) for c in ("start_ms", "end_ms")})
    copies = first.withColumn("_copy", F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    other = F.col("_copy") == 2
    copies = copies.withColumns({"status": F.when(other & (F.col("id") % 11 == 0), "changed").otherwise(F.col("status")), "start_ms": F.when(~other | (F.col("id") % 17 != 0), F.col("start_ms"))})
    return history.reconcile(copies, ["provider", "id"], ["session_id", "status", "outcome", "interval_scope", "interval_evidence"], "admitted", ["start_ms", "end_ms"], carry=True)


@query(f"""WITH {AGENT_SQL}, {_HISTORY}, s AS (SELECT * FROM sel WHERE NOT (id % 3 = 0 AND (id % 11 = 0 OR id % 17 = 0)) AND end_ms >= {FROM_MS} AND end_ms < {TO_MS})
SELECT (end_ms + 19800000) // {DAY} AS day, provider, session_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM s GROUP BY ALL""")
def selected_history(spark, sf_dir):
    return history.session_days(_history(spark, sf_dir), FROM_MS, TO_MS, history.parse_offset("+05:30"))


@query(f"""WITH {AGENT_SQL}, {_HISTORY}, c AS (SELECT id, provider, session_id, interval_scope, interval_evidence, greatest(start_ms, {FROM_MS}) AS start_ms, least(end_ms, {TO_MS}) AS end_ms FROM sel WHERE NOT (id % 3 = 0 AND (id % 11 = 0 OR id % 17 = 0)) AND end_ms > {FROM_MS} AND start_ms < {TO_MS}),
x AS (SELECT *, unnest(range((start_ms + 19800000) // {DAY}, (end_ms - 1 + 19800000) // {DAY} + 1)) AS day FROM c WHERE end_ms > start_ms),
y AS (SELECT * REPLACE (greatest(start_ms, day * {DAY} - 19800000) AS start_ms, least(end_ms, (day + 1) * {DAY} - 19800000) AS end_ms) FROM x), {islands_sql('y', 'day, provider, session_id, interval_scope, interval_evidence')}
SELECT day, provider, session_id, interval_scope, interval_evidence, CAST(sum(members) AS BIGINT) AS n, CAST(sum(summed) AS BIGINT) AS sum_ms, CAST(sum(hi - lo) AS BIGINT) AS busy_ms FROM isl GROUP BY ALL""")
def selected_busy(spark, sf_dir):
    return history.busy_days(_history(spark, sf_dir), FROM_MS, TO_MS, history.parse_offset("+05:30"))


@query(f"""WITH {AGENT_SQL}, {_HISTORY} SELECT CASE WHEN id % 3 = 0 AND id % 11 = 0 THEN 'conflict' WHEN NOT admitted THEN 'excluded' WHEN position_reason IS NOT NULL OR (id % 3 = 0 AND id % 17 = 0) THEN 'unpositioned' ELSE 'admitted' END AS state, provider, count(*) AS n FROM ad JOIN po USING (id) GROUP BY ALL""")
def selected_states(spark, sf_dir):
    """All copies are compared before anything is filtered; an admitted one without a proven place is unpositioned."""
    return _history(spark, sf_dir).groupBy("provider", "state").agg(F.count(F.lit(1)).alias("n"))
