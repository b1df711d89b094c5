"""Log ingestion over logs that Spark writes from the event table, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.functions.expr import complete_sum, fraction
from traceloom.functions.saved import saved, work_folder
from traceloom.operators import pairing, usage
from traceloom.sources import jsonl
from traceloom.sources.driver_tables import EVENTS_SQL, events
from traceloom.sources.written import write_named

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: A command for each category.
_COMMANDS = {"read": "cat notes.txt", "search": "rg needle src", "edit": "tee out.txt", "validation": "pytest -q", "command": "make build"}


#: Events of a source; there are 7 sources or more.
_EVENTS = 50_000


def write_logs(spark, sf_dir: str, folder: str, sources: int | None = None) -> None:
    """Each event as a call and a result, in the order of ids; one log for each source."""
    rows = events(spark, sf_dir)
    sources = sources or max(7, -(-rows.count() // _EVENTS))
    rows = rows.withColumn("source", F.pmod("session_id", F.lit(sources)))
    stamp = lambda ms: F.date_format(F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {ms} / 1000.0)"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    command = F.create_map(*[F.lit(x) for pair in _COMMANDS.items() for x in pair])[F.col("category")]
    call_id = F.concat(F.lit("call-"), F.col("id").cast("string"))
    code = F.when((F.col("status") == "failed") | (F.col("id") % 35 == 0), 2).when((F.col("category") == "search") & (F.col("id") % 3 == 0), 1).otherwise(0)
    call = F.to_json(F.struct(stamp("start_ms").alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.lit("function_call").alias("type"), call_id.alias("call_id"), F.lit("shell").alias("name"), F.to_json(F.struct(command.alias("command"))).alias("arguments")).alias("payload")))
    result = F.to_json(F.struct(stamp("end_ms").alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.lit("function_call_output").alias("type"), call_id.alias("call_id"), F.to_json(F.struct(code.alias("exit_code"))).alias("output")).alias("payload")))
    lines = rows.select("source", "id", F.posexplode(F.array(call, result)).alias("part", "line"))
    write_named(lines, folder, ("id", "part"))


_SQL = f"""WITH {EVENTS_SQL}, x AS (SELECT *, CASE category WHEN 'read' THEN 'read' WHEN 'search' THEN 'search' WHEN 'validation' THEN 'test' ELSE 'other' END AS c,
CASE WHEN status = 'failed' OR id % 35 = 0 THEN 2 WHEN category = 'search' AND id % 3 = 0 THEN 1 ELSE 0 END AS code FROM ev)
SELECT c AS category, CASE WHEN code = 0 OR (code = 1 AND c = 'search') THEN 'completed' WHEN c = 'search' THEN 'failed' ELSE 'unknown' END AS status, CASE WHEN code = 0 THEN 'success' WHEN c <> 'search' THEN 'unknown' WHEN code = 1 THEN 'no_match' ELSE 'error' END AS outcome, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS sum_ms FROM x GROUP BY ALL"""


def write_session_logs(spark, sf_dir: str, folder: str) -> None:
    """Sessions, turns and token usage of the event table; one log for each 50th session id.

    Every 50th event opens another session, every 10th is a turn of its own (every 30th of
    them is aborted, every 70th says both), and each reports the usage of a response that
    three events share, sometimes with other counts.
    """
    rows = events(spark, sf_dir).withColumn("source", F.pmod("session_id", F.lit(50)))
    text = lambda x: F.concat(F.lit(x), F.col("id").cast("string"))
    line = lambda kind, **body: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*[v.alias(k) for k, v in body.items()]).alias("payload")))
    turn = lambda kind, **more: line("event_msg", type=F.lit(kind), turn_id=text("t"), **more)
    at = {k: F.col(f"{c}_ms") / 1000 for k, c in (("started_at", "start"), ("completed_at", "end"))}
    tenth = F.col("id") % 10 == 0
    done = F.when(F.col("id") % 30 == 0, turn("turn_aborted", **at)).otherwise(turn("task_complete", **at))
    usage = line("token_usage_record", response_id=F.concat(F.lit("r"), F.expr("id div 3").cast("string")), usage=F.struct((F.expr("id div 3") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("input_tokens"), F.lit(5).alias("output_tokens")))
    lines = F.array(
        line("session_meta", id=F.concat(F.lit("s"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(F.col("source")).cast("string"))),
        F.when(tenth, turn("task_started", started_at=at["started_at"])), usage, F.when(tenth, done), F.when(F.col("id") % 70 == 0, turn("turn_aborted", **at)),
    )
    out = rows.select("source", "id", F.posexplode(lines).alias("part", "line")).where(F.col("line").isNotNull())
    write_named(out, folder, ("id", "part"))


def _facts(spark, sf_dir: str, write):
    return saved(pairing.codex_facts(_records(spark, sf_dir, write, "codex")))


_SESSIONS = f"WITH {EVENTS_SQL}, e AS (SELECT *, session_id % 50 AS source FROM ev)"


def ingest_turns(spark, sf_dir: str):
    """Turns from written logs: two different ends make a status unknown."""
    turns = pairing.codex_turns(_facts(spark, sf_dir, write_session_logs))
    return turns.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("sum_ms"))


def _records(spark, sf_dir: str, write, provider: str):
    folder = work_folder(spark, "logs")
    write(spark, sf_dir, folder)
    return jsonl.admitted(jsonl.read_records(spark, folder, provider))


def ingest_usage(spark, sf_dir: str):
    """Usage from written logs: a response whose records differ is withheld."""
    rows = usage.codex_usage(_records(spark, sf_dir, write_session_logs, "codex"))
    return rows.groupBy("conflicted").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("counts.input"), F.lit(0)).alias("input_tokens"))


#: Records of a log of responses that grow.
_RECORDS = 300


def write_response_logs(spark, sf_dir: str, folder: str) -> None:
    """Responses of three records each, whose output grows; some lack a count, have one of another kind, come twice, or name a message again with other content."""
    rows = events(spark, sf_dir).select("id", F.expr(f"id div {_RECORDS}").alias("source"), F.expr("id div 3").alias("r"), (F.col("id") % 3).alias("part"))
    text = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    pair = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    number = lambda c: c.cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    output = F.when(F.col("r") % 11 == 2, F.lit('"7"')).otherwise(number(F.col("part") * 10 + 1))
    parts = [pair("input_tokens", number(F.col("r"))), pair("output_tokens", output), pair("cache_creation_input_tokens", F.lit("2")), F.when(F.col("r") % 5 == 1, F.lit(None)).otherwise(pair("cache_read_input_tokens", F.when(F.col("r") % 7 == 3, F.lit("null")).otherwise(F.lit("3"))))]
    uuid = F.when(F.col("id") % 19 == 5, F.lit(None)).otherwise(pair("uuid", quoted(text("u", F.when(F.col("id") % 13 == 4, F.col("id") - 1).otherwise(F.col("id"))))))
    response = F.when(F.col("r") % 23 == 6, F.lit(None)).otherwise(pair("id", quoted(text("m", F.col("r")))))
    message = F.concat(F.lit('"message":{'), F.concat_ws(",", response, pair("content", quoted(text("t", F.col("id")))), pair("stop_reason", F.when(F.col("part") == 2, F.lit('"end_turn"')).otherwise(F.lit("null"))), F.concat(F.lit('"usage":{'), F.concat_ws(",", *parts), F.lit("}"))), F.lit("}"))
    line = F.concat(F.lit("{"), F.concat_ws(",", F.lit('"type":"assistant"'), uuid, pair("sessionId", quoted(text("s", F.col("source")))), message), F.lit("}"))
    out = rows.select("source", "id", line.alias("line"), F.explode(F.when(F.col("id") % 17 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    write_named(out, folder, ("id", "copy"))


def response_usage(spark, sf_dir: str):
    """Usage of responses that are written again while they grow: the last record counts, missing parts stay unknown."""
    rows = usage.claude_usage(_records(spark, sf_dir, write_response_logs, "claude"))
    return rows.select("session_id", "response_id", "byte_offset", *[F.col(f"counts.{c}").alias(c) for c in ("input", "output", "cached_input", "total")], "count_status", "selection", "stop_reason", "records").drop("byte_offset")


def ingest_diagnostics(spark, sf_dir: str):
    """Diagnostics from written logs: each record that names another session than the first."""
    found = pairing.codex_diagnostics(_facts(spark, sf_dir, write_session_logs))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"))


def write_message_logs(spark, sf_dir: str, folder: str) -> None:
    """Each event as a call and a result in messages; some results only acknowledge, come again with the same or another message, or lack."""
    rows = events(spark, sf_dir).withColumn("source", F.expr(f"id div {_RECORDS}"))
    stamp = lambda ms: F.date_format(F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {ms} / 1000.0)"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = lambda x: F.concat(F.lit(x), F.col("id").cast("string"))
    tool = F.create_map(*[F.lit(x) for pair in {"read": "Read", "search": "Grep", "edit": "Edit", "validation": "Bash", "command": "Bash"}.items() for x in pair])[F.col("category")]
    command = F.when(F.col("category") == "validation", "pytest -q").when(F.col("category") == "command", "make build")

    def message(kind: str, uuid, at: str, block, **more):
        parts = {"type": F.lit(kind), "uuid": uuid, "sessionId": F.concat(F.lit("s"), F.col("source").cast("string")), "timestamp": stamp(at), "message": F.struct(F.array(block).alias("content"))} | more
        return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))

    use = F.struct(F.lit("tool_use").alias("type"), text("t").alias("id"), tool.alias("name"), F.struct(command.alias("command")).alias("input"))
    back = lambda bad: F.struct(F.lit("tool_result").alias("type"), text("t").alias("tool_use_id"), bad.alias("is_error"))
    bad, none = F.col("status") == "failed", F.lit(None).cast("string")
    result = message("user", text("r"), "end_ms", back(bad))
    lines = F.array(
        message("assistant", text("c"), "start_ms", use),
        F.when(F.col("id") % 41 == 6, none).when(F.col("id") % 29 == 3, message("user", text("r"), "end_ms", back(F.lit(False)), toolUseResult=F.struct(F.lit(True).alias("isAsync")))).otherwise(result),
        F.when(F.col("id") % 31 == 4, message("user", text("r"), "end_ms", back(~bad))), F.when(F.col("id") % 37 == 5, message("user", text("x"), "end_ms", back(~bad))),
    )
    out = rows.select("source", "id", F.posexplode(lines).alias("part", "line")).where(F.col("line").isNotNull())
    write_named(out, folder, ("id", "part"))


#: Counts of a response, by id; two of three logs are of a verified program.
_COUNTS = {"input": "CASE WHEN id % 23 = 5 THEN NULL ELSE id % 50 END", "cached": "id * 7 % 60", "written": "id % 9", "output": "id % 40", "reasoning": "id % 45", "total": "id % 50 + id % 40 + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END"}


def write_counted_logs(spark, sf_dir: str, folder: str) -> None:
    """A response for each event; some come twice, some of these with other counts, some parts exceed their whole."""
    rows = events(spark, sf_dir).selectExpr("id", f"id div {_RECORDS} AS source", *[f"{e} AS {n}" for n, e in _COUNTS.items()])
    first = F.row_number().over(W.partitionBy("source").orderBy("id")) == 1
    meta = F.concat(F.lit('{"type":"session_meta","payload":{"id":"s'), F.col("source").cast("string"), F.lit('","cli_version":"'), F.when(F.col("source") % 3 == 0, "1.0").otherwise("0.157.0"), F.lit('"}}'))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))

    def record(output):
        counts = {"input_tokens": F.col("input"), "cached_input_tokens": F.col("cached"), "cache_write_input_tokens": F.col("written"), "output_tokens": output, "reasoning_output_tokens": F.col("reasoning"), "total_tokens": F.col("total")}
        body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), number(v)) for k, v in counts.items()])
        return F.concat(F.lit('{"type":"token_usage_record","payload":{"response_id":"r'), F.col("id").cast("string"), F.lit('","usage":{'), body, F.lit("}}}"))

    again = F.when(F.col("id") % 19 == 4, record(F.col("output") + 1)).when(F.col("id") % 17 == 3, record(F.col("output")))
    out = rows.withColumn("_first", first).select("source", "id", F.posexplode(F.array(F.when(F.col("_first"), meta), record(F.col("output")), again)).alias("part", "line")).where(F.col("line").isNotNull())
    write_named(out, folder, ("id", "part"))


_COUNTED = ("input", "cached_input", "cache_write_input", "output", "reasoning_output", "total")


def verified_usage(spark, sf_dir: str):
    """Usage of the first provider: parts are held against their wholes only where the program is verified."""
    rows = usage.codex_usage(_records(spark, sf_dir, write_counted_logs, "codex"))
    return rows.select("session_id", "response_id", *[F.col(f"counts.{c}").alias(c) for c in _COUNTED], "count_status", "selection", "records")


def verified_shares(spark, sf_dir: str):
    """Shares of cache reads, cache writes and reasoning, and output without reasoning, of each session's eligible responses; null where a part is unknown."""
    rows = usage.codex_usage(_records(spark, sf_dir, write_counted_logs, "codex")).where("selection = 'eligible'").select("session_id", "counts.*")
    sums = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), *[complete_sum(F.col(c)).alias(c) for c in _COUNTED])
    share = {"cache_share": ("cached_input", "input"), "cache_write_share": ("cache_write_input", "input"), "reasoning_share": ("reasoning_output", "output")}
    return sums.select("session_id", "n", *[fraction(F.col(a), F.col(b)).alias(n) for n, (a, b) in share.items()], (F.col("output") - F.col("reasoning_output")).alias("visible_output"), "total")


def message_calls(spark, sf_dir: str):
    """Calls and results in messages: acknowledged ones stay pending, repeated messages say nothing new, results that differ conflict."""
    found = pairing.claude_executions(_records(spark, sf_dir, write_message_logs, "claude"))
    return found.groupBy("kind", "category", "status", "outcome", "timing_evidence").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("sum_ms"), F.count("acknowledged_ms").alias("acknowledged"))


_VERIFIED = f"""WITH {EVENTS_SQL}, b AS (SELECT id, id // {_RECORDS} AS source, {', '.join(f'{e} AS {n}' for n, e in _COUNTS.items())}, id // {_RECORDS} % 3 <> 0 AS known, id % 19 = 4 AS twice, CASE WHEN id % 19 = 4 OR id % 17 = 3 THEN 2 ELSE 1 END AS records FROM ev),
c AS (SELECT *, known AND coalesce(cached > input, false) AS bc, known AND coalesce(written > input, false) AS bw, known AND reasoning > output AS bg, known AND coalesce(total <> input + output, false) AS bt FROM b),
d AS (SELECT *, known AND NOT bc AND NOT bw AND coalesce(cached + written > input, false) AS bb FROM c),
e AS (SELECT *, CASE WHEN bc OR bw OR bb OR bg OR bt THEN 'invalid' WHEN input IS NULL OR NOT known THEN 'partial' ELSE 'complete' END AS count_status FROM d),
rows_ AS (SELECT 's' || source AS session_id, 'r' || id AS response_id, CASE WHEN NOT twice THEN input END AS input, CASE WHEN NOT twice AND NOT bc AND NOT bb THEN cached END AS cached_input, CASE WHEN NOT twice AND NOT bw AND NOT bb THEN written END AS cache_write_input, CASE WHEN NOT twice THEN output END AS output,
  CASE WHEN NOT twice AND NOT bg THEN reasoning END AS reasoning_output, CASE WHEN NOT twice AND known AND NOT bt AND input IS NOT NULL THEN total END AS total, count_status, CASE WHEN twice THEN 'conflicted' WHEN count_status = 'invalid' THEN 'invalid' WHEN known AND input IS NOT NULL THEN 'eligible' ELSE 'provisional' END AS selection, CAST(records AS BIGINT) AS records FROM e)"""
QUERIES |= {"ingest_turns": ingest_turns, "ingest_usage": ingest_usage, "response_usage": response_usage, "message_calls": message_calls, "verified_usage": verified_usage, "verified_shares": verified_shares, "ingest_diagnostics": ingest_diagnostics}
ORACLES |= {
    "ingest_turns": f"{_SESSIONS} SELECT CASE WHEN id % 70 = 0 AND id % 30 <> 0 THEN 'unknown' WHEN id % 30 = 0 THEN 'cancelled' ELSE 'completed' END AS status, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS sum_ms FROM e WHERE id % 10 = 0 GROUP BY 1",
    "ingest_usage": f"{_SESSIONS}, u AS (SELECT source, id // 3 AS r, min(id // 3 + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) AS lo, max(id // 3 + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) AS hi FROM e GROUP BY ALL) SELECT lo <> hi AS conflicted, count(*) AS n, CAST(coalesce(sum(CASE WHEN lo = hi THEN lo END), 0) AS BIGINT) AS input_tokens FROM u GROUP BY 1",
    "verified_usage": f"{_VERIFIED} SELECT * FROM rows_",
    "verified_shares": f"""{_VERIFIED}, g AS (SELECT session_id, count(*) AS n, {', '.join(f'CASE WHEN count({c}) = count(*) THEN CAST(sum({c}) AS BIGINT) END AS {c}' for c in _COUNTED)} FROM rows_ WHERE selection = 'eligible' GROUP BY session_id)
SELECT session_id, n, CASE WHEN input > 0 AND cached_input <= input THEN cached_input / input END AS cache_share, CASE WHEN input > 0 AND cache_write_input <= input THEN cache_write_input / input END AS cache_write_share, CASE WHEN output > 0 AND reasoning_output <= output THEN reasoning_output / output END AS reasoning_share, output - reasoning_output AS visible_output, total FROM g""",
    "message_calls": f"""WITH {EVENTS_SQL}, x AS (SELECT *, id % 41 = 6 AS lacks, id % 29 = 3 AND id % 41 <> 6 AS ack, id % 31 = 4 AND id % 41 = 6 AS again, id % 37 = 5 AS other, status = 'failed' AS bad FROM ev),
y AS (SELECT *, CASE WHEN again THEN [NOT bad] WHEN lacks OR ack THEN [] ELSE [bad] END || CASE WHEN other THEN [NOT bad] ELSE [] END AS told FROM x), z AS (SELECT *, len(list_distinct(told)) > 1 AS differ FROM y)
SELECT CASE category WHEN 'read' THEN 'read' WHEN 'search' THEN 'search' WHEN 'edit' THEN 'edit' ELSE 'shell' END AS kind, CASE category WHEN 'validation' THEN 'test' WHEN 'command' THEN 'other' ELSE category END AS category, CASE WHEN differ THEN 'unknown' WHEN len(told) = 0 THEN 'pending' WHEN told[1] THEN 'failed' ELSE 'completed' END AS status,
CASE WHEN differ OR len(told) = 0 THEN 'unknown' WHEN told[1] THEN 'error' ELSE 'success' END AS outcome, CASE WHEN differ THEN 'conflicted' WHEN len(told) = 0 THEN 'unknown' ELSE 'paired' END AS timing_evidence, count(*) AS n, CAST(coalesce(sum(CASE WHEN NOT differ AND len(told) > 0 THEN duration_ms END), 0) AS BIGINT) AS sum_ms, count(CASE WHEN ack AND NOT differ THEN 1 END) AS acknowledged FROM z GROUP BY ALL""",
    "response_usage": f"""WITH {EVENTS_SQL}, e AS (SELECT id, id // {_RECORDS} AS source, id // 3 AS r, id % 3 AS part, CASE WHEN id % 19 = 5 THEN NULL WHEN id % 13 = 4 THEN id - 1 ELSE id END AS uuid FROM ev),
x AS (SELECT *, CASE WHEN r % 23 = 6 THEN NULL ELSE 'm' || r END AS response_id, r % 11 = 2 AS bad, r % 5 = 1 OR r % 7 = 3 AS lacks FROM e),
y AS (SELECT x.*, uuid IS NOT NULL AND id <> first_id AS odd FROM x LEFT JOIN (SELECT source, uuid, min(id) AS first_id FROM x WHERE uuid IS NOT NULL GROUP BY ALL) f USING (source, uuid)),
c AS (SELECT y.*, CASE WHEN id % 17 = 3 AND uuid IS NULL THEN k ELSE 0 END AS k FROM y, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR (id % 17 = 3 AND uuid IS NULL)),
g AS (SELECT source, response_id, coalesce(response_id, coalesce('u' || uuid, 'at' || id || '/' || k)) AS one, max(id) AS id, bool_or(odd) AS conflicted, count(*) AS records FROM c GROUP BY ALL)
SELECT 's' || g.source AS session_id, g.response_id, CASE WHEN NOT conflicted AND NOT lacks THEN r + 5 END AS input, CASE WHEN NOT conflicted AND NOT bad THEN part * 10 + 1 END AS output, CASE WHEN NOT conflicted AND NOT lacks THEN CAST(3 AS BIGINT) END AS cached_input,
CASE WHEN NOT conflicted AND NOT lacks AND NOT bad THEN r + 5 + part * 10 + 1 END AS total, CASE WHEN bad THEN 'invalid' WHEN lacks THEN 'partial' ELSE 'complete' END AS count_status,
CASE WHEN conflicted THEN 'conflicted' WHEN bad OR g.response_id IS NULL THEN 'invalid' ELSE 'provisional' END AS selection, CASE WHEN part = 2 THEN 'end_turn' END AS stop_reason, records FROM g JOIN (SELECT id, r, part, bad, lacks FROM x) USING (id)""",
    "ingest_diagnostics": f"{_SESSIONS}, s AS (SELECT source, 's' || CAST(CASE WHEN id % 50 = 0 THEN id ELSE source END AS VARCHAR) AS name, id FROM e), f AS (SELECT source, arg_min(name, id) AS first_name FROM s GROUP BY source) SELECT 'AMBIGUOUS_ORIGIN' AS code, count(*) AS n, count(DISTINCT source) AS sources FROM s JOIN f USING (source) WHERE name <> first_name HAVING count(*) > 0",
}


def ingest_roundtrip(spark, sf_dir: str):
    found = pairing.codex_executions(_facts(spark, sf_dir, write_logs))
    return found.groupBy("category", "status", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").cast("long").alias("sum_ms"))


QUERIES["ingest_roundtrip"] = ingest_roundtrip
ORACLES["ingest_roundtrip"] = _SQL
