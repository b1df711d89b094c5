"""Admission, proofs, timing, positions and blockers over executions that lack things, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions.saved import saved
from traceloom.operators import gates, history, native
from traceloom.sources.agent_tables import AGENT_SQL, executions, observations, sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_SUPPRESSED = """sup AS (SELECT source_id, coverage, unsupported_records, CASE WHEN availability <> 'available' THEN 'source_unavailable' WHEN NOT has_evidence THEN 'evidence_absent' WHEN state_limited OR diagnostics_dropped > 0 THEN 'state_limited'
  WHEN ambiguous_records > 0 OR EXISTS (FROM ob WHERE ob.source_id = so.source_id AND origin = 'ambiguous') THEN 'ambiguous_origin'
  WHEN parser_version > CASE provider WHEN 'codex' THEN 3 ELSE 4 END OR capability_provider <> provider OR capability_version <> parser_version THEN 'unsupported_contract'
  WHEN EXISTS (FROM ag WHERE ag.source_id = so.source_id AND parent_id IS NOT NULL) OR EXISTS (FROM ag JOIN ob ON ob.event_id = ag.id WHERE ag.source_id = so.source_id AND provider = 'codex' AND representation = 'wrapper') THEN 'unresolved_execution_relation' END AS suppressed FROM so)"""
_CLASS = """cls AS (SELECT id, CASE WHEN kind = 'model' OR category = 'model' THEN 'model'
  WHEN NOT (CASE provider WHEN 'codex' THEN (kind, tool_name) IN (('shell', 'exec_command'), ('mcp', 'mcp'), ('file_edit', 'apply_patch')) ELSE (kind, tool_name) IN (('shell', 'Bash'), ('file_read', 'Read'), ('file_write', 'Write'), ('file_edit', 'Edit'), ('search', 'Grep'), ('search', 'Glob'), ('mcp', 'mcp'), ('browser', 'browser')) END) THEN 'unsupported_call_class'
  WHEN CASE kind WHEN 'shell' THEN category NOT IN ('test', 'build', 'search', 'read', 'other') WHEN 'file_read' THEN category <> 'read' WHEN 'file_write' THEN category <> 'write' WHEN 'file_edit' THEN category <> 'edit' ELSE category <> kind END THEN 'inconsistent_category' END AS class_reason FROM ag)"""
_LINKED = """lk AS (SELECT a.*, o.* EXCLUDE (source_id, event_id), (origin <> 'ordinary' OR o_provider <> provider OR (provider = 'claude' AND o_session <> session_id)) AS odd, (o_file = file_id AND o_at = byte_offset) AS here FROM ag a JOIN ob o ON o.event_id = a.id AND o.source_id = a.source_id)"""
_ENDS = "representation = 'result' AND completion_kind = 'invocation_result' AND NOT coalesce(unassigned, false) AND is_error = (status = 'failed')"
_FAILURE = f"""{_LINKED},
fv AS (SELECT *, CASE WHEN provider = 'claude' THEN {_ENDS} WHEN record_type = 'event_msg' THEN representation = 'structured' AND transport_status = CASE WHEN status = 'failed' AND outcome = 'error' THEN 'failed' WHEN outcome IN ('no_match', 'change_detected') AND kind = 'shell' THEN 'failed' WHEN outcome IN ('success', 'unknown') AND status <> 'failed' THEN 'completed' END
  ELSE representation IN ('result', 'poll') AND transport_status = 'unknown' END IS TRUE AS fits FROM lk),
fa AS (SELECT id, bool_or(odd OR (here AND representation <> 'call' AND NOT fits)) AS bad, min(o_id) FILTER (NOT odd AND representation = 'call') AS call_id, min(o_id) FILTER (NOT odd AND here AND fits) AS end_id FROM fv GROUP BY id),
fp AS (SELECT ag.*, call_id, end_id, CASE WHEN coalesce(bad, false) OR event_provider <> provider OR NOT (CASE provider WHEN 'claude' THEN record_type = 'user' ELSE record_type IN ('event_msg', 'response_item') END) THEN 'contradictory_provenance'
  WHEN end_id IS NULL OR (call_id IS NULL AND record_type <> 'event_msg') THEN 'missing_provenance' END AS failure FROM ag LEFT JOIN fa USING (id))"""
_ADMITTED = f"""{_SUPPRESSED}, {_CLASS}, {_FAILURE},
ex AS (SELECT fp.*, suppressed, coverage, unsupported_records, CASE WHEN suppressed IS NOT NULL THEN 'source_suppressed' ELSE coalesce(class_reason, CASE status WHEN 'completed' THEN NULL WHEN 'failed' THEN NULL WHEN 'unknown' THEN 'unknown_status' ELSE status END) END AS exclusion FROM fp JOIN cls USING (id) JOIN sup USING (source_id)),
ps AS (SELECT source_id, session_id, CASE WHEN max(suppressed) IS NOT NULL THEN 'source_suppressed' WHEN count(*) FILTER (exclusion IS NULL) = 0 THEN 'no_eligible_events' WHEN count(*) FILTER (exclusion IS NULL AND failure IS NOT NULL) > 0 THEN 'provenance_unresolved' ELSE 'evaluated' END AS partition_status FROM ex GROUP BY ALL),
ad AS (SELECT ex.*, partition_status, exclusion IS NULL AND partition_status = 'evaluated' AS admitted FROM ex JOIN ps USING (source_id, session_id))"""


def _suppressed(spark, sf_dir):
    return gates.suppression(sources(spark, sf_dir), observations(spark, sf_dir), executions(spark, sf_dir))


def _admitted(spark, sf_dir):
    return native.admission(executions(spark, sf_dir), observations(spark, sf_dir), _suppressed(spark, sf_dir))


@query(f"WITH {AGENT_SQL}, {_SUPPRESSED} SELECT source_id, suppressed FROM sup")
def suppression_ladder(spark, sf_dir):
    return _suppressed(spark, sf_dir).select("source_id", "suppressed")


@query(f"WITH {AGENT_SQL}, {_CLASS} SELECT provider, coalesce(class_reason, 'counted') AS reason, count(*) AS n, min(id) AS first_id FROM ag JOIN cls USING (id) GROUP BY ALL")
def native_classes(spark, sf_dir):
    rows = executions(spark, sf_dir).withColumn("reason", F.coalesce(native.class_reason(), F.lit("counted")))
    return rows.groupBy("provider", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {AGENT_SQL}, {_FAILURE} SELECT id, failure, CASE WHEN failure IS NULL THEN call_id END AS call_id, CASE WHEN failure IS NULL THEN end_id END AS end_id FROM fp")
def provenance_proofs(spark, sf_dir):
    found = native.failure_proofs(executions(spark, sf_dir), observations(spark, sf_dir))
    proven = F.col("failure").isNull()
    return found.select("id", "failure", F.when(proven, F.col("call_id")).alias("call_id"), F.when(proven, F.col("decisive.o_id")).alias("end_id"))


@query(f"""WITH {AGENT_SQL}, {_LINKED},
sv AS (SELECT *, timing_evidence = 'source_reported' AS told, CASE WHEN provider = 'claude' THEN {_ENDS} AND observed_ms = end_ms AND (timing_evidence <> 'source_reported' OR (result_ms = duration_ms AND result_scope = duration_scope))
  WHEN timing_evidence = 'source_reported' THEN representation = 'structured' AND transport_status IN ('completed', 'failed') ELSE representation IN ('result', 'poll') END IS TRUE AS fits FROM lk),
sa AS (SELECT id, bool_or(odd OR (here AND NOT fits AND CASE WHEN provider = 'claude' THEN representation = 'result' ELSE told AND representation = 'structured' END)) AS bad, min(o_id) FILTER (NOT odd AND representation = 'call') AS call_id, min(o_id) FILTER (NOT odd AND here AND fits) AS end_id FROM sv GROUP BY id)
SELECT id, CASE WHEN coalesce(bad, false) OR event_provider <> provider THEN 'contradictory_provenance'
  WHEN NOT CASE WHEN provider = 'claude' THEN timing_evidence = 'source_reported' OR duration_scope = 'invocation_latency' WHEN timing_evidence = 'source_reported' THEN (kind = 'shell' AND duration_scope = 'process_runtime') OR (kind = 'mcp' AND duration_scope = 'invocation_latency') ELSE duration_scope = 'invocation_latency' END THEN 'unsupported_timing_representation'
  WHEN end_id IS NULL OR (call_id IS NULL AND (provider = 'claude' OR timing_evidence = 'paired_timestamps')) THEN 'missing_provenance' END AS failure FROM ag LEFT JOIN sa USING (id)""")
def slow_tool_proofs(spark, sf_dir):
    return native.slow_proofs(executions(spark, sf_dir), observations(spark, sf_dir)).select("id", "failure")


@query(f"""WITH {AGENT_SQL}, {_ADMITTED} SELECT source_id, session_id, partition_status, count(*) AS n, count(*) FILTER (exclusion IS NULL) AS tentative, count(*) FILTER (exclusion IS NULL AND failure IS NOT NULL) AS unresolved,
CASE WHEN partition_status = 'evaluated' THEN count(*) FILTER (admitted) END AS terminal_n, CASE WHEN partition_status = 'evaluated' THEN count(*) FILTER (admitted AND status = 'completed') END AS completed_n, CASE WHEN partition_status = 'evaluated' THEN count(*) FILTER (admitted AND status = 'failed') END AS failed_n FROM ad GROUP BY source_id, session_id, partition_status""")
def failure_admission(spark, sf_dir):
    open_, rated = F.col("exclusion").isNull(), F.col("partition_status") == "evaluated"
    counts = {f"{name}_n": F.count_if(F.col("admitted") & cond) for name, cond in (("terminal", F.lit(True)), ("completed", F.col("status") == "completed"), ("failed", F.col("status") == "failed"))}
    out = _admitted(spark, sf_dir).groupBy("source_id", "session_id", "partition_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(open_).alias("tentative"), F.count_if(open_ & F.col("failure").isNotNull()).alias("unresolved"), *[c.alias(n) for n, c in counts.items()])
    return out.withColumns({n: F.when(rated, F.col(n)) for n in counts})


@query(f"WITH {AGENT_SQL}, {_ADMITTED} SELECT source_id, coalesce(CASE WHEN exclusion IS NULL AND partition_status = 'provenance_unresolved' THEN 'provenance_unresolved_partition' ELSE exclusion END, 'admitted') AS reason, count(*) AS n FROM ad GROUP BY ALL")
def admission_exclusions(spark, sf_dir):
    """Each execution has one reason, so the counts of a source add up to its executions."""
    why = F.when(F.col("exclusion").isNull() & (F.col("partition_status") == "provenance_unresolved"), "provenance_unresolved_partition").otherwise(F.coalesce("exclusion", F.lit("admitted")))
    return _admitted(spark, sf_dir).groupBy("source_id", why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {AGENT_SQL}, {_ADMITTED}, tr AS (SELECT ad.*, d.representation AS by_, CASE WHEN duration_ms IS NULL THEN 'missing_duration' WHEN duration_ms < 0 THEN 'invalid_duration' WHEN duration_scope = 'unknown' THEN 'unknown_scope' WHEN timing_evidence = 'estimated' THEN 'estimated_timing' WHEN timing_evidence = 'unknown' THEN 'unknown_timing'
  WHEN provider = 'codex' AND timing_evidence = 'source_reported' AND NOT (d.representation = 'structured' AND ((kind = 'shell' AND duration_scope = 'process_runtime') OR (kind = 'mcp' AND duration_scope = 'invocation_latency'))) THEN 'unsupported_timing_representation'
  WHEN timing_evidence = 'paired_timestamps' AND (duration_scope <> 'invocation_latency' OR (provider = 'codex' AND d.representation NOT IN ('result', 'poll'))) THEN 'unsupported_timing_representation'
  WHEN provider = 'claude' AND timing_evidence = 'source_reported' AND NOT (d.result_ms = duration_ms AND d.result_scope = duration_scope) THEN 'missing_timing_provenance'
  WHEN timing_evidence = 'paired_timestamps' AND (call_id IS NULL OR start_ms IS NULL OR end_ms IS NULL OR end_ms < start_ms OR end_ms - start_ms <> duration_ms OR (provider = 'claude' AND d.observed_ms <> end_ms)) THEN 'missing_timing_provenance' END AS why
  FROM ad JOIN ob d ON d.o_id = end_id AND d.event_id = ad.id WHERE admitted)
SELECT source_id, coalesce(why, 'measured') AS reason, count(*) AS n, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS sum_ms FROM tr GROUP BY ALL""")
def admitted_timing(spark, sf_dir):
    rows = _admitted(spark, sf_dir).where("admitted").withColumn("reason", F.coalesce(native.timing_reason(), F.lit("measured")))
    return rows.groupBy("source_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("sum_ms"))


_POSITIONS = """po AS (SELECT a.id, CASE WHEN a.start_ms IS NULL OR a.end_ms IS NULL THEN 'missing_boundaries' WHEN a.end_ms < a.start_ms THEN 'invalid_boundaries' WHEN NOT (st OR pr) THEN 'unsupported_interval'
  WHEN first_why IS NOT NULL THEN first_why WHEN NOT coalesce(has_end, false) OR (pr AND NOT coalesce(has_call, false)) THEN 'missing_position_proof' END AS position_reason
  FROM (SELECT *, provider = 'codex' AND record_type = 'event_msg' AND interval_scope = 'item_lifecycle' AND interval_evidence = 'source_reported' AS st, interval_scope = 'invocation_latency' AND interval_evidence = 'paired_timestamps' AND record_type = CASE provider WHEN 'codex' THEN 'response_item' ELSE 'user' END AS pr FROM ag) a
  LEFT JOIN (SELECT id, bool_or(c) AS has_call, bool_or(e) AS has_end, arg_min(CASE WHEN bt THEN 'contradictory_turn_proof' ELSE 'contradictory_terminal_time' END, o_at) FILTER (bt OR late) AS first_why FROM (
    SELECT *, (c AND o_turn IS DISTINCT FROM turn_id) OR (e AND o_turn IS DISTINCT FROM turn_id AND (st2 OR o_turn IS NOT NULL)) AS bt, e AND o_provider = 'claude' AND observed_ms IS DISTINCT FROM end_ms AS late FROM (
      SELECT *, representation = 'call' AND o_at < byte_offset AND o_file = file_id AND origin = 'ordinary' AS c, here AND origin = 'ordinary' AND CASE WHEN st2 THEN representation = 'structured' ELSE representation IN ('result', 'poll') END AS e FROM (
        SELECT *, provider = 'codex' AND record_type = 'event_msg' AND interval_scope = 'item_lifecycle' AND interval_evidence = 'source_reported' AS st2 FROM lk WHERE representation <> 'wrapper'))) GROUP BY id) f ON f.id = a.id)"""


@query(f"WITH {AGENT_SQL}, {_LINKED}, {_POSITIONS} SELECT id, position_reason FROM po")
def event_positions(spark, sf_dir):
    return native.positions(executions(spark, sf_dir), observations(spark, sf_dir)).select("id", "position_reason")


@query(f"""WITH {AGENT_SQL}, {_ADMITTED}, {_POSITIONS}, r AS (SELECT ad.*, position_reason, kind <> 'model' AND category <> 'model' AS rel FROM ad JOIN po USING (id)), p AS (SELECT * FROM r WHERE rel AND admitted AND position_reason IS NULL),
w AS (SELECT source_id, session_id, byte_offset = lag(byte_offset) OVER x AS tie, start_ms < lag(end_ms) OVER x AS over_, start_ms <= lag(start_ms) OVER x OR end_ms <= lag(end_ms) OVER x AS back_ FROM p WINDOW x AS (PARTITION BY source_id, session_id ORDER BY byte_offset, id)),
f AS (SELECT source_id, session_id, suppressed AS reason FROM r WHERE suppressed IS NOT NULL
  UNION SELECT source_id, session_id, 'provenance_unresolved' FROM r WHERE partition_status = 'provenance_unresolved' UNION SELECT source_id, session_id, 'incomplete_temporal_context' FROM r WHERE coverage <> 'recognized_shapes' OR unsupported_records > 0
  UNION SELECT source_id, session_id, 'opaque_action_in_stream' FROM r WHERE rel AND (kind IN ('other', 'skill', 'subagent', 'mcp', 'browser') OR (kind = 'shell' AND category NOT IN ('test', 'build', 'search', 'read')))
  UNION SELECT source_id, session_id, 'nonterminal_or_unadmitted_action' FROM r WHERE rel AND NOT admitted UNION SELECT source_id, session_id, 'unpositioned_action' FROM r WHERE rel AND admitted AND position_reason IS NOT NULL
  UNION SELECT source_id, session_id, 'unconfirmed_edit_effect' FROM r WHERE rel AND kind IN ('file_edit', 'file_write') AND (status <> 'completed' OR outcome <> 'success') UNION SELECT source_id, session_id, 'missing_turn_identity' FROM r WHERE rel AND provider = 'codex' AND turn_id IS NULL
  UNION SELECT source_id, session_id, 'inconsistent_source_file' FROM p GROUP BY 1, 2 HAVING count(DISTINCT file_id) > 1 UNION SELECT source_id, session_id, 'mixed_interval_contracts' FROM p GROUP BY 1, 2 HAVING count(DISTINCT interval_scope || interval_evidence) > 1
  UNION SELECT source_id, session_id, 'ambiguous_source_order' FROM w WHERE tie UNION SELECT source_id, session_id, 'overlapping_actions' FROM w WHERE over_ UNION SELECT source_id, session_id, 'tied_or_contradictory_boundaries' FROM w WHERE back_)
SELECT s.source_id, s.session_id, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons FROM (SELECT DISTINCT source_id, session_id FROM ag) s LEFT JOIN f USING (source_id, session_id) GROUP BY ALL""")
def session_blockers(spark, sf_dir):
    """Why the order of a session can't be used by the rules over patterns."""
    seen, origins = observations(spark, sf_dir), saved(sources(spark, sf_dir))
    # One row for each session, read twice: for what suppresses its source, and for its reasons.
    met = saved(native.examined_sessions(executions(spark, sf_dir), seen))
    related = met.groupBy("source_id").agg(F.bool_or("is_related").alias("_related"))
    found = native.blockers_of(met, saved(gates.suppression(origins, seen, related=related)))
    return found.select("source_id", "session_id", F.array_join("reasons", ",").alias("reasons"))


_COPIES = """cp AS (SELECT id, source_id, status AS sig, outcome AS sig2, id % 37 <> 1 AS admitted, start_ms, CASE WHEN start_ms IS NOT NULL THEN end_ms END AS end_ms FROM ag
UNION ALL SELECT id, source_id + 100, CASE WHEN id % 11 = 0 THEN 'changed' ELSE status END, outcome, id % 37 <> 1 AND id % 13 <> 0, CASE WHEN id % 17 <> 0 THEN start_ms END, CASE WHEN id % 17 <> 0 AND start_ms IS NOT NULL THEN end_ms + CASE WHEN id % 19 = 0 THEN 1 ELSE 0 END END FROM ag WHERE id % 2 = 0)"""


@query(f"""WITH {AGENT_SQL}, {_COPIES}, g AS (SELECT id, count(*) AS copies, count(DISTINCT sig || '/' || sig2) AS sigs, count(*) FILTER (admitted) AS yes, count(*) FILTER (start_ms IS NULL) AS nowhere, count(DISTINCT CAST(start_ms AS VARCHAR) || '/' || CAST(end_ms AS VARCHAR)) AS places FROM cp GROUP BY id)
SELECT id, copies, CASE WHEN sigs > 1 THEN 'conflict' WHEN yes > 0 AND yes < copies THEN 'conflict' WHEN yes = 0 THEN 'excluded' WHEN nowhere > 0 THEN 'unpositioned' WHEN places > 1 THEN 'conflict' ELSE 'admitted' END AS state FROM g""")
def history_reconcile(spark, sf_dir):
    """Copies that differ in meaning, admission, place, or lack a place."""
    rows = executions(spark, sf_dir)
    first = rows.select("id", "status", "outcome", (F.col("id") % 37 != 1).alias("admitted"), "start_ms", F.when(F.col("start_ms").isNotNull(), F.col("end_ms")).alias("end_ms"))
    there = F.col("id") % 17 != 0
    second = first.where("id % 2 = 0").select(
        "id", F.when(F.col("id") % 11 == 0, "changed").otherwise(F.col("status")).alias("status"), "outcome", (F.col("admitted") & (F.col("id") % 13 != 0)).alias("admitted"),
        F.when(there, F.col("start_ms")).alias("start_ms"), F.when(there, F.col("end_ms") + (F.col("id") % 19 == 0).cast("int")).alias("end_ms"),
    )
    return history.reconcile(first.unionByName(second), ["id"], ["status", "outcome"], "admitted", ["start_ms", "end_ms"])


@query(f"""WITH {AGENT_SQL}, t0 AS (SELECT id, status, start_ms, end_ms, interval_scope, interval_evidence, duration_ms + CASE WHEN id % 5 = 0 THEN 1000 ELSE 0 END AS d, CASE WHEN id % 3 = 0 THEN interval_scope ELSE duration_scope END AS ds, timing_evidence AS te FROM ag),
t1 AS (SELECT id, status, CASE WHEN end_ms < start_ms THEN NULL ELSE start_ms END AS s, CASE WHEN end_ms < start_ms THEN NULL ELSE end_ms END AS e, interval_scope, interval_evidence, d IS NULL OR te = 'unknown' OR ds = 'unknown' AS nd, d, ds, te FROM t0),
t2 AS (SELECT *, s IS NULL OR e IS NULL OR interval_scope = 'unknown' OR interval_evidence = 'unknown' AS ni FROM t1),
t3 AS (SELECT *, NOT nd AND NOT ni AND ds = interval_scope AND abs(d - (e - s)) > 1 AS x FROM t2),
t4 AS (SELECT *, nd OR status = 'pending' OR (x AND NOT (te = 'source_reported' AND interval_evidence <> 'source_reported')) AS no_d, ni OR status = 'pending' OR (x AND NOT (interval_evidence = 'source_reported' AND te <> 'source_reported')) AS no_i FROM t3)
SELECT id, x AS timing_conflict, CASE WHEN NOT no_d THEN d END AS duration_ms, CASE WHEN no_d THEN 'unknown' ELSE ds END AS duration_scope, CASE WHEN no_d THEN 'unknown' ELSE te END AS timing_evidence, s AS start_ms, CASE WHEN status <> 'pending' THEN e END AS end_ms,
CASE WHEN no_i THEN 'unknown' ELSE interval_scope END AS interval_scope, CASE WHEN no_i THEN 'unknown' ELSE interval_evidence END AS interval_evidence FROM t4""")
def timing_conflict(spark, sf_dir):
    rows = executions(spark, sf_dir).select(
        "id", "status", "start_ms", "end_ms", "interval_scope", "interval_evidence", (F.col("duration_ms") + F.when(F.col("id") % 5 == 0, 1000).otherwise(0)).alias("duration_ms"),
        F.when(F.col("id") % 3 == 0, F.col("interval_scope")).otherwise(F.col("duration_scope")).alias("duration_scope"), "timing_evidence",
    )
    return gates.resolve_timing(rows).select("id", "timing_conflict", "duration_ms", "duration_scope", "timing_evidence", "start_ms", "end_ms", "interval_scope", "interval_evidence")
