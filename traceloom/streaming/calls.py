"""Calls and their results on a stream of records, with state for open calls only.

Each open call is one sealed entry of a map, as is each result that came before its call.
An entry goes when the call is closed, so the state follows what is open, not what was
read. An entry holds plain columns, a format version and a keyed digest over them and
their place; one that was changed, belongs elsewhere or is of another version is refused.
Nothing is pickled. Records of a source must come in byte order; a call id that comes
again after its call was closed is another execution.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from traceloom.functions.evidence import output_header
from traceloom.functions.identity import classify, exit_meaning

VERSION = 1
ROW = "source_id string, id string, byte_offset long, category string, pattern string, start_ms long, end_ms long, status string, outcome string, exit_code int"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
_ENTRY = "version int, seal string, body string"


class RefusedState(ValueError):
    """State that this version with this key didn't write."""


class Sealer:
    """Writes and reads entries: version, seal and a body of JSON."""

    def __init__(self, key: bytes, version: int = VERSION):
        self.key, self.version = key, version

    def _seal(self, place: str, body: str) -> str:
        return hmac.new(self.key, f"{self.version}\n{place}\n{body}".encode(), hashlib.sha256).hexdigest()

    def close(self, place: str, fields: dict) -> tuple[int, str, str]:
        body = json.dumps(fields, sort_keys=True)
        return self.version, self._seal(place, body), body

    def open(self, place: str, entry: tuple[int, str, str]) -> dict:
        version, seal, body = entry
        if version != self.version:
            raise RefusedState(f"{place}: state of version {version}, this is {self.version}")
        if not hmac.compare_digest(seal, self._seal(place, body)):
            raise RefusedState(f"{place}: the seal of the state doesn't hold")
        return json.loads(body)


def read_record(raw: str) -> tuple[str, str, dict] | None:
    """(call or result, call id, what it says) of a record; null if it is neither."""
    record = json.loads(raw)
    body = record.get("payload") if record.get("type") == "response_item" else None
    if not isinstance(body, dict) or not isinstance(body.get("call_id"), str) or not body["call_id"]:
        return None
    at = _ms(record.get("timestamp"))
    if body.get("type") in ("function_call", "custom_tool_call"):
        try:
            args = json.loads(body.get("arguments") or "{}")
        except ValueError:
            args = None
        command = args.get("command", args.get("cmd")) if isinstance(args, dict) else None
        pattern, category, policy, _ = classify(command) if isinstance(command, str) else (None, "other", "unknown", False)
        return "call", body["call_id"], {"pattern": pattern, "category": category, "policy": policy, "at": at}
    if body.get("type") in ("function_call_output", "custom_tool_call_output"):
        output = body.get("output")
        try:
            told = json.loads(output) if isinstance(output, str) else output
        except ValueError:
            told = output_header(output)
        told = told if isinstance(told, dict) else {}
        code = told.get("exit_code")
        code = code if isinstance(code, int) and not isinstance(code, bool) else None
        return "result", body["call_id"], {"code": code, "running": bool(told.get("running") or (told.get("session_id") and code is None)), "at": at}
    return None


def _ms(text) -> int | None:
    from datetime import UTC, datetime

    try:
        return round(datetime.fromisoformat(text[:-1]).replace(tzinfo=UTC).timestamp() * 1000) if text.endswith("Z") else None
    except (AttributeError, TypeError, ValueError):
        return None


def executions(source: str, records: Iterator[tuple[int, str]], calls, early) -> Iterator[tuple]:
    """Rows of the calls that records open or close. ``calls`` and ``early`` are maps of what is open: get, put, remove."""
    for offset, raw in records:
        found = read_record(raw)
        if found is None:
            continue
        what, id_, told = found
        if what == "call":
            if calls.get(id_) is not None:  # a call that is open already is repeated
                continue
            call = told | {"offset": offset}
            if (result := early.get(id_)) is None:
                calls.put(id_, call)
                yield _row(source, id_, call, None)
            else:
                early.remove(id_)
                yield _row(source, id_, call, result)
        elif (call := calls.get(id_)) is None:
            if not told["running"]:
                early.put(id_, told)
        elif not told["running"]:
            calls.remove(id_)
            yield _row(source, id_, call, told)


def _row(source: str, id_: str, call: dict, result: dict | None) -> tuple:
    status, outcome = exit_meaning(result["code"], call["policy"]) if result else ("pending", "unknown")
    end = result["at"] if result else None
    start = call["at"]
    if start is not None and end is not None and end < start:
        start = end = None
    return source, id_, call["offset"], call["category"], call["pattern"], start, end, status, outcome, result["code"] if result else None


class _Map:
    """A map of sealed entries in the state store."""

    def __init__(self, state, place: str, sealer: Sealer):
        self.state, self.place, self.sealer = state, place, sealer

    def get(self, id_: str) -> dict | None:
        entry = self.state.getValue((id_,))
        return None if entry is None else self.sealer.open(f"{self.place}/{id_}", tuple(entry))

    def put(self, id_: str, fields: dict) -> None:
        self.state.updateValue((id_,), self.sealer.close(f"{self.place}/{id_}", fields))

    def remove(self, id_: str) -> None:
        self.state.removeKey((id_,))


class OpenCalls(StatefulProcessor):
    """One source's open calls and early results between micro-batches."""

    def __init__(self, key: bytes, version: int = VERSION):
        self.sealer = Sealer(key, version)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getMapState("calls", "id string", _ENTRY)
        self.early = handle.getMapState("early", "id string", _ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        source = key[0]
        ordered = sorted((r.byte_offset, r.raw) for r in rows)
        for out in executions(source, iter(ordered), _Map(self.calls, f"{source}/calls", self.sealer), _Map(self.early, f"{source}/early", self.sealer)):
            yield Row(**dict(zip(_NAMES, out, strict=True)))

    def close(self) -> None:
        pass


def open_calls(records: DataFrame, key: bytes, version: int = VERSION) -> DataFrame:
    """Executions that each micro-batch of records (source_id, byte_offset, raw) opens or closes; a later row of an id and offset replaces the earlier.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). The key
    is a parameter of the job and isn't kept with the state.
    """
    return records.groupBy("source_id").transformWithState(statefulProcessor=OpenCalls(key, version), outputStructType=ROW, outputMode="Update", timeMode="None")
