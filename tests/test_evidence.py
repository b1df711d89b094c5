"""Parsers of tool output."""

import pytest

from traceloom.functions import evidence as E
from traceloom.functions.identity import shell_words


def header(code=None, running=None, wall=1000.0, output=""):
    return {"exit_code": code, "running": running is not None, "wall_ms": wall, "process_id": running, "output": output}


@pytest.mark.parametrize(("text", "want"), [
    ("Wall time: 1.5 seconds\nProcess exited with code 0\nOutput:\nhello", header(0, None, 1500.0, "hello")),
    ("Chunk ID: a1\nWall time: 2 seconds\nProcess running with session ID 77\nOriginal token count: 5\nOutput:\n", header(None, "77", 2000.0)),
    ("Wall time: 1 seconds\nProcess running with session ID ab-1\nOutput:\nx\nOutput:\ny", header(None, "ab-1", output="x\nOutput:\ny")),
    ("Wall time: 1 seconds\nOutput:\nx", header(output="x")), ("Wall time: 1 seconds\nProcess exited with code -9\nOutput:", header(-9)),
    ("Wall time: 1 seconds\nProcess exited with code 1\nProcess running with session ID 7\nOutput:\n", None), ("Wall time: 1 seconds\nmore\nOutput:\n", None), ("Wall time: 1. seconds\nOutput:\n", None),
    ("Chunk ID: " + "a" * 129 + "\nWall time: 1 seconds\nOutput:\n", None), (" Wall time: 1 seconds\nOutput:\n", None), ("Wall time: 1 seconds\nOutput: \n", None), ("Wall time: " + "1" * 8200 + " seconds\nOutput:\n", None), ("", None), (None, None),
])
def test_output_header(text, want):
    assert E.output_header(text) == want


def test_search_identity():
    one = E.search_identity("Grep", {"pattern": "x", "path": "a"}, "2.1")
    assert one == E.search_identity("Grep", {"path": "a", "pattern": "x"}, "2.1") != E.search_identity("Grep", {"pattern": "x"}, "2.1")
    assert one != E.search_identity("Grep", {"pattern": "x", "path": "a"}, "2.2") and one != E.search_identity("Grep", {"pattern": "x", "path": "a", "-i": False}, "2.1")
    assert E.search_identity("Grep", {"pattern": "x", "-i": True, "multiline": False, "output_mode": "count", "glob": "*.py"}, "2")
    for more in ({"type": "py"}, {"-n": True}, {"head_limit": 5}, {"-i": "yes"}, {"glob": ""}, {"output_mode": "lines"}, {"path": "a\0"}, {"path": None}, {"glob": "x" * (1 << 20) + "y"}):
        assert E.search_identity("Grep", {"pattern": "x"} | more, "2") is None
    for tool, args, version in (("Read", {"pattern": "x"}, "2"), ("Glob", {"pattern": "x", "glob": "y"}, "2"), ("Glob", {"path": "x"}, "2"), ("Glob", {"pattern": "x"}, ""), ("Glob", {"pattern": "x"}, None), ("Glob", None, "2")):
        assert E.search_identity(tool, args, version) is None


@pytest.mark.parametrize(("patch", "changed"), [([{"oldLines": 1, "newLines": 2, "lines": [" a", "+b"]}], True), ([{"oldLines": 1, "newLines": 1, "lines": [" a"]}], False), ([{"oldLines": 2, "newLines": 1, "lines": [" a"]}], None), (None, None), ([], False)])
def test_patches(patch, changed):
    assert E.changed_patch(patch) is changed


def test_unified_diff():
    good = "--- a\n+++ b\n@@ -1,2 +1,2 @@\n same\n-old\n+new"
    assert E.unified_diff_changes(good) == (1, 1)
    assert E.unified_diff_changes(good.replace("+1,2", "+1,3")) is None
    assert E.unified_diff_changes("") == (0, 0)


@pytest.mark.parametrize("text", ["  ", "x [truncated]", "y" * 70_000, "the output was truncated", "[12 lines omitted]", "Warning:  Truncated", "lines truncated", "truncated response", "a <persisted-output> b", "\ud800", None, ""])
def test_errors_that_are_not_whole(text):
    assert E.error_text(text) is None


def test_error_text():
    for text in ("boom", "truncate table x", "[" + "a" * 40 + "omitted" + "b" * 40 + "]"):
        assert E.error_text(text) == text


def test_omissions():
    assert not E.evidence_omitted(None) and not E.evidence_omitted({}) and not E.evidence_omitted({"truncated": False, "content_state": "complete"})
    assert all(E.evidence_omitted(x) for x in ({"truncated": True}, {"interrupted": None}, {"isImage": 0}, {"content_state": "partial"}, "text", [1]))


@pytest.mark.parametrize(("command", "words"), [
    ("npm  test", ["npm", "test"]), (" a ", ["a"]), ("a''", ["a"]), ("'' b", ["", "b"]), ("a'b c'd", ["ab cd"]), (r"a\ b", ["a b"]), (r'"a\"b\\c\d"', ['a"b\\c\\d']), (r"'a\'", ["a\\"]), ('"x y"z', ["x yz"]), ("é 'ü ß'", ["é", "ü ß"]), ("x A=1", ["x", "A=1"]), ("a\u00a0b", ["a", "b"]),
    ("A=1 x", None), ("a | b", None), ("a 'b", None), ('a "b', None), ("a\\", None), ("a $b", None), ("a `b`", None), ("a\nb", None), ("a;b", None), ("a #b", None), ("~/x", None), ("a 'x*' *", None), ("a '*;#'", ["a", "*;#"]), ("", None), (None, None), ("   ", None), ("'A'=1", None), ("x'", None),
])
def test_shell_words(command, words):
    assert shell_words(command) == words
