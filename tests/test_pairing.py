"""Executions out of records by joins: what the records of one call say, in any order."""

import json

from traceloom.operators import pairing


def stamp(s):
    return f"2026-01-01T00:00:{s:02d}.000Z"


def item(kind, s, **body):
    return {"timestamp": stamp(s), "type": "response_item", "payload": {"type": kind, **body}}


def call(i, s, command="pytest -q"):
    return item("function_call", s, call_id=f"c{i}", name="shell", arguments=json.dumps({"command": command}))


def result(i, s, code):
    return item("function_call_output", s, call_id=f"c{i}", output=json.dumps({"exit_code": code}))


def said(i, s, out):
    return item("function_call_output", s, call_id=i, output=out if isinstance(out, str) else json.dumps(out))


def poll(i, s, process, chars=""):
    return item("function_call", s, call_id=i, name="write_stdin", arguments=json.dumps({"session_id": process, "chars": chars}))


def meta(name, **more):
    return {"timestamp": stamp(0), "type": "session_meta", "payload": {"id": name} | more}


def turn(kind, **more):
    return {"type": "event_msg", "payload": {"type": kind, "turn_id": "t1", **more}}


def frame(spark, logs):
    rows = [(s, k, 10 * k, json.dumps(r)) for s, records in logs.items() for k, r in enumerate(records)]
    return spark.createDataFrame(rows, "source_id string, ordinal long, byte_offset long, raw string").repartition(3)


def run(spark, logs, width=1 << 20):
    facts = pairing.codex_facts(frame(spark, logs)).cache()
    return facts, {(r.source_id, r.id): r for r in pairing.codex_executions(facts, width).collect()}


def log():
    done = {"type": "CommandExecution", "id": "i1", "command": "make build", "exit_code": 0, "duration": {"secs": 0, "nanos": 9000000}}
    bad = {"type": "McpToolCall", "id": "i2", "status": "failed"}
    return [
        meta("s1"), {"timestamp": stamp(0), "type": "turn_context", "payload": {"turn_id": "t1"}},
        call(1, 1), result(1, 3, 0), call(2, 4), result(2, 5, 2), result(3, 7, 1), call(3, 6, "rg x src"), call(4, 8), call(1, 1), result(1, 3, 0), call(5, 9), result(5, 10, 0), result(5, 11, 1),
        {"timestamp": stamp(12), "type": "event_msg", "payload": {"type": "item_completed", "started_at_ms": 5, "completed_at_ms": 20, "item": done}}, {"type": "event_msg", "payload": {"type": "item_completed", "started_at_ms": 30, "completed_at_ms": 20, "item": bad}},
        meta("other"), {"type": "turn_context", "payload": {"turn_id": "t2"}}, call(6, 14), call(7, 15), result(7, 2, 0), call(8, 16, ["bash", "-lc", "rg y"]), result(8, 17, 2),
    ]


def test_calls_and_results(spark):
    for width in (3, 1 << 20):
        facts, got = run(spark, {"a": log(), "b": log()}, width)
        assert {k for k in got} == {(s, i) for s in "ab" for i in ("c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8", "i1", "i2")}
        e = {i: r for (s, i), r in got.items() if s == "b"}
        assert (e["c1"].status, e["c1"].duration_ms, e["c1"].turn_id, e["c1"].session_id, e["c1"].category, e["c1"].byte_offset) == ("completed", 2000.0, "t1", "s1", "test" if e["c1"].category == "test" else "other", 20)
        assert (e["c2"].status, e["c2"].outcome, e["c2"].exit_code) == ("unknown", "unknown", 2)  # a program whose codes aren't known
        assert (e["c3"].outcome, e["c3"].duration_ms) == ("no_match", 1000.0)
        assert (e["c4"].status, e["c4"].timing_evidence) == ("pending", "unknown")
        assert (e["c5"].status, e["c5"].timing_evidence, e["c5"].end_ms) == ("unknown", "conflicted", None)
        assert (e["i1"].duration_ms, e["i1"].timing_evidence, e["i1"].category, e["i1"].status, e["i1"].start_ms) == (9.0, "source_reported", "other", "completed", 5)
        assert (e["i2"].status, e["i2"].outcome, e["i2"].start_ms, e["i2"].kind) == ("failed", "error", None, "mcp")
        assert e["c6"].ambiguous and e["c6"].turn_id == "t2" and not e["c4"].ambiguous
        assert (e["c7"].status, e["c7"].start_ms, e["c7"].end_ms) == ("completed", None, None)  # its end is before its start
        assert (e["c8"].status, e["c8"].outcome, e["c8"].category) == ("failed", "error", "search")
    codes = sorted((r.source_id, r.code, r.byte_offset) for r in pairing.codex_diagnostics(facts).collect())
    assert codes == [(s, *x) for s in "ab" for x in (("AMBIGUOUS_ORIGIN", 160), ("REORDERED_RECORD", 60))]


def test_headers_polls_and_wrappers(spark):
    wrap = item("custom_tool_call", 1, call_id="w", name="exec", input="x")
    start = [call(1, 1), wrap, said("w", 2, {"exit_code": 1})]
    done, open_ = "Wall time: 0.5 seconds\nProcess exited with code 1\nOutput:\nx", "Wall time: 0.5 seconds\nProcess running with session ID ab-7\nOutput:\n"
    logs = {
        "polled": [*start, said("c1", 3, {"session_id": 7}), poll("p1", 4, 7), said("p1", 5, {"session_id": 7}), poll("p2", 6, 7), said("p2", 8, {"exit_code": 0})],
        "early": [*start, poll("p1", 4, 7), said("p1", 5, {"exit_code": 0}), said("c1", 6, {"session_id": 7})], "late": [*start, said("c1", 3, {"session_id": 7}), said("p1", 5, {"exit_code": 1}), poll("p1", 4, 7)],
        "two": [*start, call(2, 2), said("c1", 3, {"session_id": 7}), said("c2", 3, {"session_id": 7}), poll("p1", 4, 7), said("p1", 5, {"exit_code": 0})], "odd": [*start, said("c1", 3, {"session_id": 7}), poll("p1", 4, 7, "text"), said("p1", 5, {"exit_code": 0})],
        "twice": [*start, said("c1", 3, {"session_id": 7}), poll("p1", 4, 7), said("p1", 5, {"exit_code": 0}), poll("p2", 6, 7), said("p2", 7, {"exit_code": 1})],
        "done": [call(1, 1, "rg x"), said("c1", 2, done)], "open": [call(1, 1, "rg x"), said("c1", 2, open_), poll("p1", 3, "ab-7"), said("p1", 4, done)], "text": [call(1, 1, "rg x"), said("c1", 2, "some text")], "none": [result(1, 1, 0)],
    }
    _, got = run(spark, logs)
    assert {k: (r.status, r.outcome, r.exit_code) for k, r in got.items()} == {
        ("polled", "c1"): ("completed", "success", 0), ("early", "c1"): ("completed", "success", 0), ("late", "c1"): ("unknown", "unknown", 1), ("two", "c1"): ("pending", "unknown", None), ("two", "c2"): ("pending", "unknown", None), ("odd", "c1"): ("pending", "unknown", None),
        ("twice", "c1"): ("unknown", "unknown", 0), ("done", "c1"): ("completed", "no_match", 1), ("open", "c1"): ("completed", "no_match", 1), ("text", "c1"): ("unknown", "unknown", None),
    }
    assert got["polled", "c1"].duration_ms == 7000.0 and got["twice", "c1"].timing_evidence == "conflicted"


def test_turns(spark):
    logs = {"a": [meta("s1"), turn("task_started", started_at=1), turn("task_complete", completed_at=3)], "b": [turn("task_started", started_at=1), turn("task_complete", completed_at=3), turn("turn_aborted", completed_at=4)], "c": [turn("task_started")], "d": [turn("turn_aborted")]}
    facts, _ = run(spark, logs)
    assert {r.source_id: (r.status, r.start_ms, r.end_ms, r.session_id) for r in pairing.codex_turns(facts).collect()} == {"a": ("completed", 1000, 3000, "s1"), "b": ("unknown", 1000, 4000, None), "c": ("pending", None, None, None), "d": ("cancelled", None, None, None)}


def message(uuid, role, content, s, **more):
    return {"type": role, "uuid": uuid, "sessionId": "s", "timestamp": stamp(s), "message": {"id": f"m{uuid}", "role": role, "content": content}} | more


def use(i, name, args):
    return {"type": "tool_use", "id": i, "name": name, "input": args}


def back(i, bad):
    return {"type": "tool_result", "tool_use_id": i, "is_error": bad}


def test_blocks_of_messages(spark):
    records = [
        message("a", "assistant", [use("u1", "Bash", {"command": "pytest"}), use("u2", "Read", {}), {"type": "text", "text": "x"}], 1), message("b", "user", [back("u1", True), back("u2", False)], 4), message("b", "user", [back("u1", False)], 5),
        message("c", "assistant", [use("u3", "Bash", {"command": "sleep"}), use("u4", "mcp__x__y", {}), use("u5", "Task", {})], 6), message("d", "user", [back("u3", False)], 7, toolUseResult={"backgroundTaskId": "t"}), message("e", "user", "text", 8), message("f", "user", [back("u4", False)], 9), message("g", "user", [back("u4", True)], 10),
        message("h", "assistant", [use("u6", "Grep", {})], 11, sessionId="other"),
    ]
    got = {r.id: r for r in pairing.claude_executions(frame(spark, {"a": records})).collect()}
    assert {k: (r.status, r.kind, r.duration_ms) for k, r in got.items()} == {"u1": ("failed", "shell", 3000.0), "u2": ("completed", "read", 3000.0), "u3": ("pending", "shell", None), "u4": ("unknown", "mcp", None), "u5": ("pending", "subagent", None), "u6": ("pending", "search", None)}
    assert got["u3"].acknowledged_ms - got["u3"].start_ms == 1000 and got["u6"].ambiguous and not got["u1"].ambiguous and got["u6"].session_id == "s"
