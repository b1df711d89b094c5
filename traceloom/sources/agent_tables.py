"""The event table as agent logs with all that logs can lack: unknown, pending, cancelled, ambiguous, unpositioned.

Each event is an execution of one of two providers, with the observations that may
prove it. The mapping is synthetic. Its expressions are SQL that Spark and DuckDB read
alike, so both sides of a check see the same rows; the rules on top of them do not
share any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceloom.sources.driver_tables import EVENTS_SQL, events

_BASE = {
    "id": "id", "session_id": "session_id", "event_type": "tool", "source_id": "session_id % 50", "provider": "CASE WHEN session_id % 2 = 0 THEN 'codex' ELSE 'claude' END",
    "start_raw": "start_ms", "took": "duration_ms % 5000", "op_key": "op_key",
}
_PLAIN = {
    "event_provider": "CASE WHEN id % 1511 = 7 THEN 'other' ELSE provider END",
    "kind": "CASE WHEN id % 97 = 3 THEN 'model' WHEN event_type = 'view' THEN CASE WHEN provider = 'codex' THEN 'mcp' ELSE 'file_read' END WHEN event_type = 'click' THEN CASE WHEN provider = 'codex' THEN 'shell' ELSE 'search' END WHEN event_type = 'signup' THEN 'file_edit' ELSE 'shell' END",
    "tool_name": "CASE WHEN id % 89 = 4 THEN 'other' WHEN event_type = 'view' THEN CASE WHEN provider = 'codex' THEN 'mcp' ELSE 'Read' END WHEN event_type = 'signup' THEN CASE WHEN provider = 'codex' THEN 'apply_patch' ELSE 'Edit' END WHEN provider = 'codex' THEN 'exec_command' WHEN event_type = 'click' THEN 'Grep' ELSE 'Bash' END",
    "category": "CASE WHEN id % 83 = 5 THEN 'skill' WHEN event_type = 'view' THEN CASE WHEN provider = 'codex' THEN 'mcp' ELSE 'read' END WHEN event_type = 'click' THEN 'search' WHEN event_type = 'signup' THEN 'edit' WHEN event_type = 'purchase' THEN 'test' ELSE 'other' END",
    "status": "CASE WHEN id % 23 = 0 THEN 'pending' WHEN id % 29 = 0 THEN 'cancelled' WHEN id % 31 = 0 THEN 'unknown' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END",
    "record_type": "CASE WHEN id % 1601 = 9 THEN 'system' WHEN provider = 'claude' THEN 'user' WHEN (session_id % 4 = 0) <> (id % 701 = 1) THEN 'event_msg' ELSE 'response_item' END",
    "byte_offset": "id * 10 + 5", "file_id": "CASE WHEN id % 1301 = 2 THEN source_id + 1000 ELSE source_id END", "turn_id": "CASE WHEN id % 1103 = 3 THEN NULL ELSE session_id * 1000 + id % 7 END", "parent_id": "CASE WHEN id % 2003 = 5 THEN id - 1 END",
    "start_ms": "CASE WHEN id % 907 = 6 THEN NULL ELSE start_raw END", "end_ms": "CASE WHEN id % 911 = 6 THEN start_raw - 1 ELSE start_raw + took END", "duration_ms": "CASE WHEN id % 47 <> 1 THEN took END",
}
_DERIVED = {
    "outcome": "CASE WHEN status = 'failed' THEN 'error' WHEN status <> 'completed' THEN 'unknown' WHEN event_type = 'click' AND id % 3 = 0 THEN 'no_match' ELSE 'success' END",
    "timing_evidence": "CASE WHEN id % 37 = 2 THEN 'estimated' WHEN id % 41 = 2 THEN 'unknown' WHEN record_type = 'event_msg' OR (provider = 'claude' AND id % 5 = 0) THEN 'source_reported' ELSE 'paired_timestamps' END",
    "duration_scope": "CASE WHEN id % 43 = 2 THEN 'unknown' WHEN record_type = 'event_msg' AND kind = 'shell' THEN 'process_runtime' ELSE 'invocation_latency' END",
    "interval_scope": "CASE WHEN record_type = 'event_msg' THEN 'item_lifecycle' ELSE 'invocation_latency' END",
    "interval_evidence": "CASE WHEN id % 1009 = 8 THEN 'estimated' WHEN record_type = 'event_msg' THEN 'source_reported' ELSE 'paired_timestamps' END",
}
_OBSERVED = ("o_id", "event_id", "source_id", "origin", "representation", "o_provider", "o_session", "o_file", "o_at", "o_turn", "transport_status", "is_error", "completion_kind", "observed_ms", "result_ms", "result_scope", "unassigned")
_NOTHING = ["CAST(NULL AS boolean)", "CAST(NULL AS varchar(20))", "CAST(NULL AS bigint)", "CAST(NULL AS bigint)", "CAST(NULL AS varchar(20))", "CAST(NULL AS boolean)"]
_TURN = "session_id * 1000 + id % 7"
_PARTS = [
    (["id * 10", "id", "source_id", "CASE WHEN id % 1703 = 1 THEN 'ambiguous' ELSE 'ordinary' END", "'call'", "provider", "session_id", "source_id", "id * 10", _TURN, "'unknown'", *_NOTHING], "id % 1201 <> 4"),
    ([
        "id * 10 + 5", "id", "source_id", "'ordinary'", "CASE WHEN record_type = 'event_msg' THEN 'structured' WHEN provider = 'codex' AND id % 3 = 0 THEN 'poll' ELSE 'result' END", "provider", "session_id", "source_id", "id * 10 + 5", f"CASE WHEN id % 1409 = 5 THEN -1 ELSE {_TURN} END",
        "CASE WHEN record_type <> 'event_msg' THEN CASE WHEN id % 1217 = 6 THEN 'completed' ELSE 'unknown' END WHEN id % 1213 = 6 THEN 'pending' WHEN status = 'failed' OR outcome = 'no_match' THEN 'failed' ELSE 'completed' END",
        "status = 'failed'", "CASE WHEN id % 1223 = 7 THEN 'acknowledgement' ELSE 'invocation_result' END", "CASE WHEN id % 503 = 8 THEN end_ms + 1 ELSE end_ms END", "took", "duration_scope", "id % 1227 = 8",
    ], "id % 1231 <> 3"),
    (["id * 10 + 7", "id", "source_id", "'ordinary'", "'poll'", "provider", "session_id", "source_id", "id * 10 + 7", _TURN, "'failed'", *_NOTHING], "id % 13 = 0"),
    (["id * 10 + 8", "CASE WHEN id % 1999 = 11 THEN id ELSE -id END", "source_id", "'ordinary'", "'wrapper'", "provider", "session_id", "source_id", "id * 10 + 8", _TURN, "'unknown'", *_NOTHING], "provider = 'codex' AND (id % 50 = 0 OR id % 1999 = 11)"),
]
_SOURCES = {
    "availability": "CASE WHEN source_id % 17 = 16 THEN 'unavailable' ELSE 'available' END", "has_evidence": "source_id % 19 <> 18", "state_limited": "source_id % 23 = 22", "diagnostics_dropped": "CASE WHEN source_id % 29 = 28 THEN 2 ELSE 0 END",
    "ambiguous_records": "CASE WHEN source_id % 31 = 30 THEN 1 ELSE 0 END", "parser_version": "CASE WHEN source_id % 11 = 10 THEN 9 ELSE 1 + source_id % 3 END", "capability_provider": "CASE WHEN source_id % 37 = 36 THEN 'other' ELSE provider END", "capability_version": "CASE WHEN source_id % 11 = 10 THEN 9 ELSE 1 + source_id % 3 END",
    "coverage": "CASE WHEN source_id % 3 = 1 THEN 'partial' ELSE 'recognized_shapes' END", "unsupported_records": "CASE WHEN source_id % 13 = 12 THEN 1 ELSE 0 END",
}


def _columns(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in exprs.items()]


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions of both providers."""
    rows = events(spark, sf_dir).selectExpr(*_columns(_BASE))
    return rows.selectExpr("*", *_columns(_PLAIN)).selectExpr("*", *_columns(_DERIVED))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the logs say about executions: calls, results, polls, wrappers."""
    rows, out = executions(spark, sf_dir), None
    for exprs, where in _PARTS:
        part = rows.where(where).selectExpr(*_columns(dict(zip(_OBSERVED, exprs, strict=True))))
        out = part if out is None else out.unionByName(part)
    return out


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executions(spark, sf_dir).select("source_id", "provider").distinct().selectExpr("*", *_columns(_SOURCES))


AGENT_SQL = f"""{EVENTS_SQL}, b0 AS (SELECT {', '.join(_columns(_BASE))} FROM ev), b1 AS (SELECT *, {', '.join(_columns(_PLAIN))} FROM b0), ag AS (SELECT *, {', '.join(_columns(_DERIVED))} FROM b1),
ob AS ({' UNION ALL '.join(f"SELECT {', '.join(_columns(dict(zip(_OBSERVED, e, strict=True))))} FROM ag WHERE {w}" for e, w in _PARTS)}),
so AS (SELECT *, {', '.join(_columns(_SOURCES))} FROM (SELECT DISTINCT source_id, provider FROM ag))"""
