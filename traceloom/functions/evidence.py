"""Small parsers of what tools print and return. Batch-wise helpers for the fold and for UDFs."""

from __future__ import annotations

import hashlib
import json
import re

#: The lines of a header. What follows ``Output:`` is not looked at.
_HEADER = re.compile(
    r"(?:Chunk ID: [A-Za-z0-9_-]{1,128}\n)?Wall time: (?P<wall>[0-9]+(?:\.[0-9]+)?) seconds"
    r"(?:\nProcess exited with code (?P<code>-?[0-9]+)|\nProcess running with session ID (?P<session>[A-Za-z0-9_-]{1,128}))?(?:\nOriginal token count: [0-9]+)?"
)
_HEADER_MOST = 8192
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
#: Keys a search may have and still be identified, those that are yes or no, and the modes of output.
_SEARCH_KEYS = {"Grep": ("pattern", "path", "glob", "output_mode", "-i", "multiline"), "Glob": ("pattern", "path")}
_SWITCHES, _MODES, _SEARCH_MOST = ("-i", "multiline"), ("content", "files_with_matches", "count"), 1 << 20
#: Marks of output that isn't whole, and fields of a record that say so unless they are false.
_CUT = re.compile(r"warning:\s*truncated|(?:output|content|response|lines?)\s+(?:was\s+)?truncated|truncated\s+(?:output|content|response)|\[.{0,32}(?:truncated|omitted).{0,32}\]|<persisted-output>", re.IGNORECASE)
_OMITTING = ("truncated", "isTruncated", "interrupted", "isImage", "isAsync")


def output_header(text: str | None) -> dict | None:
    """Exit code or running session (or neither), wall time in ms and the output after a strict header; else null."""
    text = text or ""
    end = text.find("\nOutput:\n")
    body = text[end + len("\nOutput:\n") :] if end >= 0 else ""
    if end < 0:
        end = len(text) - len("\nOutput:") if text.endswith("\nOutput:") else -1
    m = _HEADER.fullmatch(text[:end]) if 0 <= end <= _HEADER_MOST else None
    if not m:
        return None
    return {"exit_code": int(m["code"]) if m["code"] else None, "running": m["session"] is not None, "wall_ms": float(m["wall"]) * 1000, "process_id": m["session"], "output": body}


def search_identity(tool: str, args: dict | None, version: str | None) -> str | None:
    """Key of a search of one version of its tool; null if a key is unknown or a value of the wrong kind.

    A search without path is not one of an explicit path.
    """
    allowed = _SEARCH_KEYS.get(tool)
    if not allowed or not isinstance(version, str) or not 0 < len(version) <= 4096 or not isinstance(args, dict) or "pattern" not in args or set(args) - set(allowed):
        return None
    for key, value in args.items():
        if key in _SWITCHES:
            good = isinstance(value, bool)
        else:
            good = isinstance(value, str) and value != "" and len(value.encode("utf-8", "surrogatepass")) <= _SEARCH_MOST and not (key in ("pattern", "path") and "\0" in value) and (key != "output_mode" or value in _MODES)
        if not good:
            return None
    where = ["explicit_path", args["path"]] if "path" in args else ["record_cwd"]
    parts = [tool, version, args["pattern"], where, {k: args[k] for k in sorted(args) if k not in ("pattern", "path")}]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def changed_patch(patch: list | None) -> bool | None:
    """Whether a structured patch changes lines; null if its hunks don't add up."""
    if not isinstance(patch, list):
        return None
    changed = False
    for hunk in patch:
        lines = hunk.get("lines") if isinstance(hunk, dict) else None
        if not isinstance(lines, list) or not all(isinstance(x, str) and x[:1] in (" ", "+", "-", "\\") for x in lines):
            return None
        old, new = sum(x[0] in " -" for x in lines), sum(x[0] in " +" for x in lines)
        if (old, new) != (hunk.get("oldLines"), hunk.get("newLines")):
            return None
        changed |= any(x[0] in "+-" for x in lines)
    return changed


def unified_diff_changes(text: str | None) -> tuple[int, int] | None:
    """Lines added and removed by a unified diff; null if a hunk's counts don't hold."""
    added = removed = 0
    want: tuple[int, int] | None = None
    old = new = 0
    for line in (text or "").split("\n"):
        m = _HUNK.match(line)
        if m or line.startswith(("--- ", "+++ ")) and want == (old, new):
            if want is not None and want != (old, new):
                return None
            want, old, new = ((int(m[2] or 1), int(m[4] or 1)), 0, 0) if m else (None, 0, 0)
        elif want is not None and want != (old, new) and line[:1] in (" ", "+", "-"):
            old, new = old + (line[0] in " -"), new + (line[0] in " +")
            added, removed = added + (line[0] == "+"), removed + (line[0] == "-")
    return (added, removed) if want in (None, (old, new)) else None


def evidence_omitted(record) -> bool:
    """Whether a record says that what it holds isn't whole. Nothing says nothing; what is no object can't be trusted."""
    if record is None:
        return False
    if not isinstance(record, dict):
        return True
    return any(key in record and record[key] is not False for key in _OMITTING) or ("content_state" in record and record["content_state"] != "complete")


def error_text(text: str | None, most: int = 64 << 10) -> str | None:
    """The recorded error if it is whole: not blank, without a mark of omission, not longer than ``most`` bytes, no half characters."""
    if not text or not text.strip() or _CUT.search(text):
        return None
    try:
        return text if len(text.encode()) <= most else None
    except UnicodeEncodeError:
        return None
