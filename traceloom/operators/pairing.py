"""Executions, turns and diagnostics out of log records, by grouping and joins.

A record is parsed once; what it says becomes a row of facts, and the facts are saved.
Calls and results meet by an equal join on source and call, in whatever order they
came, so a source of any size is many tasks. A repeated fact changes nothing; facts of
one call that differ make it conflicted and none wins. What was going on when a record was
written (its turn) is told by running sums over blocks of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.expr import utc_ms
from traceloom.functions.identity import command_class
from traceloom.functions.saved import saved
from traceloom.operators.blocks import WIDTH, running
from traceloom.operators.usage import _text, once, parsed

#: Names of tools and their kinds, names that run commands, and the category of a kind.
KINDS = {"Bash": "shell", "Read": "read", "Edit": "edit", "MultiEdit": "edit", "Write": "edit", "Grep": "search", "Glob": "search", "Task": "subagent", "Agent": "subagent", "WebFetch": "browser", "WebSearch": "browser"}
SHELLS = ("shell", "exec_command", "local_shell")
PLAIN = ("read", "search", "edit")
#: What exit code 1 says of a program whose codes are known.
ONE = {"rg": "no_match", "git_diff": "change_detected"}
#: The header of an output that is plain text, as in ``functions.evidence``.
_HEADER = r"^(?:Chunk ID: [A-Za-z0-9_-]{1,128}\n)?Wall time: [0-9]+(?:\.[0-9]+)? seconds(?:\nProcess exited with code (-?[0-9]{1,9})|\nProcess running with session ID ([A-Za-z0-9_-]{1,128}))?(?:\nOriginal token count: [0-9]+)?(?:\nOutput:\n|\nOutput:$)"
_KEY = ["source_id", "id"]


def _get(path: str, kind: str, v: str = "v") -> Column:
    return F.try_variant_get(v, path, kind)


def _schema(path: str, v: str = "v") -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))


def _differ(*parts: str) -> Column:
    """Whether the rows of a group differ in any of the columns; nulls are values."""
    text = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return F.min(text) != F.max(text)


def exit_status(code: Column, policy: Column) -> tuple[Column, Column]:
    """Status and outcome of an exit code. A code above zero fails only where the program is known to mean it."""
    known, one = policy.isin(*ONE), F.create_map(*[F.lit(x) for pair in ONE.items() for x in pair])[policy]
    status = F.when(code == 0, "completed").when((code == 1) & known, "completed").when((code >= 2) & known, "failed").otherwise("unknown")
    outcome = F.when(code == 0, "success").when((code == 1) & known, one).when((code >= 2) & known, "error").otherwise("unknown")
    return status, outcome


def _tool(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(name.isin(*SHELLS), "shell").when(name.startswith("mcp__"), "mcp").otherwise(F.coalesce(table[name], F.lit("other")))


def _sessions(rows: DataFrame) -> DataFrame:
    """Per source: the first session, where it was named, and from where on another's records may stand."""
    first = rows.groupBy("source_id").agg(F.min(F.struct("ordinal", "session")).alias("f"))
    strange = rows.join(first, "source_id").where(F.col("forked") | ~F.col("session").eqNullSafe(F.col("f.session"))).groupBy("source_id").agg(F.min("ordinal").alias("strange_from"))
    return first.join(strange, "source_id", "left").select("source_id", F.col("f.session").alias("session_id"), F.col("f.ordinal").alias("session_from"), "strange_from")


def codex_facts(records: DataFrame) -> DataFrame:
    """One row for each record of the first provider that says something of sessions, turns, calls or their results."""
    rows = parsed(records)
    kind, what = _text("$.type"), _text("$.payload.type")
    rows = once(rows, {"_at": _text("$.timestamp")})
    rows = once(rows, {"_type": kind, "_what": what, "at_ms": utc_ms(F.col("_at")), "_call": _text("$.payload.call_id"), "_name": _text("$.payload.name"), "_space": _text("$.payload.namespace"), "_item": _text("$.payload.item.type")})
    item_, response = F.col("_type") == "event_msg", F.col("_type") == "response_item"
    plain = F.col("_space").isNull() | (F.col("_space") == "functions")
    is_call = response & F.col("_what").isin("function_call", "custom_tool_call") & F.col("_call").isNotNull()
    fact = (
        F.when(F.col("_type") == "session_meta", "session").when(F.col("_type") == "turn_context", "turn").when(item_ & F.col("_what").isin("task_started", "task_complete", "turn_aborted") & _text("$.payload.turn_id").isNotNull(), F.col("_what"))
        .when(is_call & (F.col("_name") == "exec") & plain, "wrapper").when(is_call & (F.col("_name") == "write_stdin") & plain, "poll").when(is_call, "call").when(response & F.col("_what").isin("function_call_output", "custom_tool_call_output") & F.col("_call").isNotNull(), "result")
        .when(item_ & (F.col("_what") == "item_completed") & F.col("_item").isin("CommandExecution", "McpToolCall") & _text("$.payload.item.id").isNotNull(), "item")
    )
    rows = once(rows, {"fact": fact}).where("fact IS NOT NULL")
    rows = once(rows, {"_a": F.try_parse_json(_text("$.payload.arguments")), "_o": F.when(_schema("$.payload.output") == "STRING", F.try_parse_json(_get("$.payload.output", "string"))).otherwise(_get("$.payload.output", "variant"))})
    words = lambda path, v: F.when(_schema(path, v).startswith("ARRAY"), _get(path, "array<string>", v))
    joined = lambda a: F.when((F.size(a) == 3) & F.get(a, 1).isin("-c", "-lc"), F.get(a, 2)).otherwise(F.array_join(a, " "))
    line = lambda path, v: F.coalesce(F.when(_schema(path, v) == "STRING", _get(path, "string", v)), joined(words(path, v)))
    command = F.when(F.col("fact") == "item", F.coalesce(F.when(_schema("$.payload.item.command") == "STRING", _get("$.payload.item.command", "string")), F.array_join(words("$.payload.item.command", "v"), " "))).when(F.col("_name").isin(*SHELLS), F.coalesce(line("$.command", "_a"), line("$.cmd", "_a")))
    output = F.when(F.col("_o").isNull(), _get("$.payload.output", "string"))
    whole = lambda path, v: F.when(_schema(path, v) == "BIGINT", _get(path, "bigint", v))
    code = F.coalesce(whole("$.exit_code", "_o"), whole("$.metadata.exit_code", "_o"), F.nullif(F.regexp_extract(output, _HEADER, 1), F.lit("")).cast("long"))
    process = F.coalesce(_get("$.session_id", "string", "_o"), F.nullif(F.regexp_extract(output, _HEADER, 2), F.lit("")))
    told = _get("$.payload.item.duration.secs", "double") * 1000 + F.coalesce(_get("$.payload.item.duration.nanos", "double"), F.lit(0.0)) / 1e6
    mcp = F.col("_item") == "McpToolCall"
    return rows.select(
        "source_id", "ordinal", "byte_offset", "at_ms", "fact", F.when(F.col("fact") == "item", _text("$.payload.item.id")).otherwise(F.col("_call")).alias("id"), F.when(F.col("fact") == "item", F.when(mcp, "mcp").otherwise("shell")).otherwise(_tool(F.coalesce("_name", F.lit("")))).alias("kind"),
        F.nullif(command, F.lit("")).alias("command"), F.when(F.col("fact") == "item", F.when(~mcp, whole("$.payload.item.exit_code", "v"))).otherwise(code).cast("int").alias("code"), F.when(mcp, _text("$.payload.item.status") == "failed").alias("failed"),
        F.coalesce(_get("$.running", "boolean", "_o"), F.lit(False)).alias("_said"), process.alias("process"), F.when(F.col("fact") == "poll", F.when(_get("$.chars", "string", "_a") == "", _get("$.session_id", "string", "_a"))).alias("polled"),
        _get("$.payload.started_at_ms", "bigint").alias("item_start"), _get("$.payload.completed_at_ms", "bigint").alias("item_end"), told.alias("told"), _text("$.payload.turn_id").alias("turn_id"), _text("$.payload.id").alias("session"), _text("$.payload.forked_from_id").isNotNull().alias("forked"),
        F.floor(_get("$.payload.started_at", "double") * 1000 + 0.5).cast("long").alias("turn_start"), F.floor(_get("$.payload.completed_at", "double") * 1000 + 0.5).cast("long").alias("turn_end"),
    ).withColumn("running", F.col("_said") | (F.col("process").isNotNull() & F.col("code").isNull())).drop("_said")


def codex_executions(facts: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each execution: source_id, id, session_id, turn_id, kind, category, pattern, times, status, outcome, exit_code, ambiguous, byte_offset.

    A structured item outranks call and result. A poll tells of the execution that launched
    its process, if only one did; wrappers are no executions. What runs on is pending.
    """
    placed = running(facts.where("fact IN ('turn', 'task_started', 'call', 'item')"), ["source_id"], "ordinal", width, sums={"_turn": F.col("fact").isin("turn", "task_started").cast("long")})
    turns = placed.where("fact IN ('turn', 'task_started')").select("source_id", "_turn", F.col("turn_id").alias("_turn_id"))
    head = F.min(F.struct("ordinal", "byte_offset", "at_ms", "kind", "command", "_turn"))
    calls = placed.where("fact = 'call'").groupBy(*_KEY).agg(head.alias("c"), _differ("kind", "command", "at_ms").alias("c_differ"))
    end = F.min(F.struct("ordinal", "byte_offset", "kind", "command", "_turn", "code", "failed", "item_start", "item_end", "told"))
    items = placed.where("fact = 'item'").groupBy(*_KEY).agg(end.alias("i"), _differ("code", "failed", "item_start", "item_end", "told").alias("i_differ"))
    polls = facts.where("fact = 'poll'").groupBy(*_KEY).agg(F.min("polled").alias("polled"))
    results = facts.where("fact = 'result'").drop("polled").join(facts.where("fact = 'wrapper'").select(*_KEY).distinct(), _KEY, "left_anti").join(polls, _KEY, "left").withColumn("_poll", F.col("polled").isNotNull()).join(polls.where("polled IS NULL").select(*_KEY), _KEY, "left_anti")
    own = results.where("NOT _poll")
    launched = own.where("running AND process IS NOT NULL").join(calls.select(*_KEY), _KEY, "left_semi").groupBy("source_id", F.col("process").alias("polled")).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo = _hi")
    through = results.where("_poll AND (process IS NULL OR process = polled)").join(launched, ["source_id", "polled"]).withColumn("id", F.col("_lo"))
    columns = [*_KEY, "ordinal", "at_ms", "code", "running", "process", "_poll"]
    final = F.when(~F.col("running"), F.struct("ordinal", "at_ms", "code"))
    code = F.when(~F.col("running"), F.coalesce("code", F.lit(1 << 40)))
    own_text = F.when(~F.col("_poll"), F.to_json(F.struct("at_ms", "code", "running", "process"), {"ignoreNullFields": "false"}))
    ended = own.select(*columns).unionByName(through.select(*columns)).groupBy(*_KEY).agg(F.min(final).alias("r"), (F.coalesce(F.min(own_text) != F.max(own_text), F.lit(False)) | F.coalesce(F.min(code) != F.max(code), F.lit(False))).alias("r_differ"))
    met = calls.join(items, _KEY, "full").join(ended, _KEY, "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    met = met.withColumns({"conflicted": no(F.col("c_differ")) | no(F.col("i_differ")) | (F.col("i").isNull() & no(F.col("r_differ"))), "kind": F.coalesce("c.kind", "i.kind"), "_class": command_class(F.coalesce("c.command", "i.command")), "command": F.coalesce("c.command", "i.command"), "_turn": F.coalesce("c._turn", "i._turn"), "_first": F.least("c.ordinal", "i.ordinal")})
    by_code = exit_status(F.coalesce("i.code", F.when(F.col("i").isNull(), F.col("r.code"))), F.when(F.col("command").isNotNull(), F.col("_class.policy")).otherwise("unknown"))
    by_flag = F.when(F.col("i.failed"), "failed").otherwise("completed"), F.when(F.col("i.failed"), "error").otherwise("success")
    over = F.col("i").isNotNull() | F.col("r").isNotNull()
    status, outcome = (F.when(F.col("conflicted"), "unknown").when(~over, waits).when(F.col("i.failed").isNotNull(), flag).otherwise(coded) for waits, flag, coded in (("pending", by_flag[0], by_code[0]), ("unknown", by_flag[1], by_code[1])))
    times = {"start_ms": F.when(F.col("i").isNotNull(), F.col("i.item_start")).otherwise(F.col("c.at_ms")), "end_ms": F.when(F.col("i").isNotNull(), F.col("i.item_end")).otherwise(F.col("r.at_ms"))}
    met = met.withColumns({"status": status, "outcome": outcome} | {k: F.when(~F.col("conflicted"), v) for k, v in times.items()})
    forward = F.col("end_ms").isNull() | F.col("start_ms").isNull() | (F.col("end_ms") >= F.col("start_ms"))
    met = met.withColumns({k: F.when(forward, F.col(k)) for k in ("start_ms", "end_ms")})
    took = (F.col("end_ms") - F.col("start_ms")).cast("double")
    evidence = F.when(F.col("conflicted"), "conflicted").when(F.col("i.told").isNotNull(), "source_reported").when(took.isNotNull(), "paired").otherwise("unknown")
    named = met.join(turns, ["source_id", "_turn"], "left").join(_sessions(facts.where("fact = 'session'")), "source_id", "left")
    category = F.when(F.col("command").isNotNull(), F.col("_class.category")).otherwise(F.when(F.col("kind").isin(*PLAIN), F.col("kind")).otherwise("other"))
    return named.select(
        *_KEY, F.when(F.col("session_from") < F.col("_first"), F.col("session_id")).alias("session_id"), F.col("_turn_id").alias("turn_id"), "kind", category.alias("category"), F.when(F.col("command").isNotNull(), F.col("_class.pattern")).alias("pattern"), "start_ms", "end_ms",
        F.when(~F.col("conflicted"), F.coalesce("i.told", took)).alias("duration_ms"), evidence.alias("timing_evidence"), "status", "outcome", F.when(F.col("i").isNotNull(), F.col("i.code")).otherwise(F.col("r.code")).alias("exit_code"), no(F.col("_first") >= F.col("strange_from")).alias("ambiguous"), F.least("c.byte_offset", "i.byte_offset").alias("byte_offset"),
    )


def codex_turns(facts: DataFrame) -> DataFrame:
    """Turns: two ends that differ make the status unknown; of times the last told count."""
    mine = facts.where("fact IN ('task_started', 'task_complete', 'turn_aborted')")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("ordinal", F.col(c).alias("v"))))["v"]
    done, cut = (F.bool_or(F.col("fact") == x) for x in ("task_complete", "turn_aborted"))
    status = F.when(done & cut, "unknown").when(done, "completed").when(cut, "cancelled").otherwise("pending")
    found = mine.groupBy("source_id", F.col("turn_id").alias("id")).agg(last("turn_start").alias("start_ms"), F.max(F.when(F.col("turn_end").isNotNull() & (F.col("fact") != "task_started"), F.struct("ordinal", F.col("turn_end").alias("v"))))["v"].alias("end_ms"), status.alias("status"), F.min("ordinal").alias("_first"), F.min("byte_offset").alias("byte_offset"))
    named = found.join(_sessions(facts.where("fact = 'session'")), "source_id", "left")
    return named.select("source_id", "id", F.when(F.col("session_from") < F.col("_first"), F.col("session_id")).alias("session_id"), "start_ms", "end_ms", "status", "byte_offset")


def codex_diagnostics(facts: DataFrame) -> DataFrame:
    """source_id, code, byte_offset: records of other sessions, results before their calls, polls of no or several executions."""
    metas = facts.where("fact = 'session'")
    strange = metas.join(_sessions(metas).select("source_id", "session_id"), "source_id").where(F.col("forked") | ~F.col("session").eqNullSafe(F.col("session_id"))).select("source_id", F.lit("AMBIGUOUS_ORIGIN").alias("code"), "byte_offset")
    calls = facts.where("fact = 'call'").groupBy(*_KEY).agg(F.min("ordinal").alias("_called"))
    early = facts.where("fact = 'result'").join(calls, _KEY).where(F.col("ordinal") < F.col("_called")).groupBy(*_KEY).agg(F.min("byte_offset").alias("byte_offset")).select("source_id", F.lit("REORDERED_RECORD").alias("code"), "byte_offset")
    vague = facts.where("fact = 'poll' AND polled IS NULL").select("source_id", F.lit("UNSUPPORTED_RELATION").alias("code"), "byte_offset")
    return strange.unionByName(early).unionByName(vague).distinct()


def claude_executions(records: DataFrame) -> DataFrame:
    """Executions of the second provider, whose calls and results are blocks of messages.

    Of messages that share a uuid the first counts. A result that only acknowledges
    background work leaves its call pending; ``acknowledged_ms`` tells when it came.
    """
    rows = once(parsed(records), {"_at": _text("$.timestamp")}).select("source_id", "ordinal", "byte_offset", "v", utc_ms(F.col("_at")).alias("at_ms"), _text("$.uuid").alias("uuid"), _text("$.sessionId").alias("session"))
    ack = (_text("$.toolUseResult.backgroundTaskId").isNotNull()) | F.coalesce(_get("$.toolUseResult.isAsync", "boolean"), F.lit(False))
    blocks = _get("$.message.content", "array<variant>")  # null for anything else
    facts = rows.select("source_id", "ordinal", "byte_offset", "at_ms", "uuid", "session", F.coalesce(_text("$.forkedFromSessionId").isNotNull(), F.lit(False)).alias("forked"), ack.alias("ack"), F.explode_outer(blocks).alias("v"))
    facts = once(facts, {"type": _text("$.type"), "_name": F.coalesce(_text("$.name"), F.lit(""))})
    # All that is read of a record is saved before messages are told apart: only these short rows are shuffled.
    facts = saved(facts.select(
        "source_id", "ordinal", "byte_offset", "at_ms", "uuid", "session", "forked", "ack", "type", F.when(F.col("type") == "tool_use", _text("$.id")).when(F.col("type") == "tool_result", _text("$.tool_use_id")).alias("id"),
        _tool(F.col("_name")).alias("kind"), F.when(_tool(F.col("_name")) == "shell", _text("$.input.command")).alias("command"), F.coalesce(_get("$.is_error", "boolean"), F.lit(False)).alias("failed"),
    ))
    again = saved(facts.where("uuid IS NOT NULL").groupBy("source_id", "uuid").agg(F.min("ordinal").alias("_first"), F.max("ordinal").alias("_last")).where("_first < _last").drop("_last"))
    facts = saved(facts.join(again, ["source_id", "uuid"], "left").where(F.col("_first").isNull() | (F.col("ordinal") == F.col("_first"))).drop("_first", "uuid"))
    calls = facts.where("type = 'tool_use' AND id IS NOT NULL").groupBy(*_KEY).agg(F.min(F.struct("ordinal", "byte_offset", "at_ms", "kind", "command", "session")).alias("c"), _differ("kind", "command", "at_ms").alias("c_differ"))
    told = facts.where("type = 'tool_result' AND id IS NOT NULL")
    text = F.when(~F.col("ack"), F.to_json(F.struct("failed", "at_ms"), {"ignoreNullFields": "false"}))
    ended = told.groupBy(*_KEY).agg(F.min(F.when(~F.col("ack"), F.struct("ordinal", "at_ms", "failed"))).alias("r"), F.min(F.when(F.col("ack"), F.col("at_ms"))).alias("acknowledged_ms"), F.coalesce(F.min(text) != F.max(text), F.lit(False)).alias("r_differ"))
    no = lambda c: F.coalesce(c, F.lit(False))
    met = calls.join(ended, _KEY, "left").withColumn("conflicted", no(F.col("c_differ")) | no(F.col("r_differ"))).withColumn("_class", command_class(F.col("c.command")))
    state = lambda waits, bad, good: F.when(F.col("conflicted"), "unknown").when(F.col("r").isNull(), waits).when(F.col("r.failed"), bad).otherwise(good)
    forward = no(F.col("r.at_ms") >= F.col("c.at_ms")) | F.col("r.at_ms").isNull() | F.col("c.at_ms").isNull()
    fine = ~F.col("conflicted") & forward
    met = met.withColumns({"start_ms": F.when(fine, F.col("c.at_ms")), "end_ms": F.when(fine, F.col("r.at_ms")), "status": state("pending", "failed", "completed"), "outcome": state("unknown", "error", "success")})
    metas = facts.where("session IS NOT NULL")
    named = met.join(_sessions(metas), "source_id", "left")
    kind = F.col("c.kind")
    category = F.when(F.col("c.command").isNotNull(), F.col("_class.category")).otherwise(F.when(kind.isin(*PLAIN), kind).otherwise("other"))
    took = (F.col("end_ms") - F.col("start_ms")).cast("double")
    return named.select(
        *_KEY, "session_id", kind.alias("kind"), category.alias("category"), F.when(F.col("c.command").isNotNull(), F.col("_class.pattern")).alias("pattern"), "start_ms", "end_ms", took.alias("duration_ms"), F.when(F.col("conflicted"), "conflicted").when(took.isNotNull(), "paired").otherwise("unknown").alias("timing_evidence"),
        "status", "outcome", F.when(~F.col("conflicted"), F.col("acknowledged_ms")).alias("acknowledged_ms"), no(F.col("c.ordinal") >= F.col("strange_from")).alias("ambiguous"), F.col("c.byte_offset").alias("byte_offset"),
    )
