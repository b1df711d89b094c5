"""Proofs of logs and verified appends."""

import io
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from traceloom.functions.saved import saved
from traceloom.sources import appends, jsonl


def line(k, **more):
    return json.dumps({"k": k} | more).encode() + b"\n"


def put(folder, name, content):
    (folder / name).write_bytes(content)
    os.utime(folder / name, (1, 1))


def texts(df):
    return sorted((r.file.rsplit("/", 1)[-1], r.status, r.start, r.parsed_bytes) for r in df.collect())


def full(spark, folder):
    """What a reading of everything gives."""
    rows = jsonl.admitted(jsonl.read_records(spark, str(folder), "codex"))
    return sorted((r.source_id, r.ordinal, r.byte_offset, r.next_offset, r.raw) for r in rows.collect())


def plain(df):
    return sorted((r.source_id, r.ordinal, r.byte_offset, r.next_offset, r.raw) for r in df.collect())


@pytest.mark.parametrize(("block", "size"), [(16, 40), (1 << 20, 1 << 26)])
def test_appended_rewritten_and_truncated_logs(spark, tmp_path, block, size):
    logs = tmp_path / "logs"
    logs.mkdir()
    base = {n: b"".join(line(k, n=n) for k in range(9)) for n in "abcdefgh"}
    for n, content in base.items():
        put(logs, f"{n}.jsonl", content + (b'{"half' if n == "b" else b""))
    put(logs, "empty.jsonl", b"")
    one = appends.advance(spark, str(logs), "codex", block=block, size=size)
    assert {s for _, s, _, _ in texts(one.outcomes)} == {"new"}
    assert plain(one.records) == full(spark, logs)
    records, proofs = saved(one.records), saved(one.proofs)

    more = line(9) + line(10)
    put(logs, "b.jsonl", base["b"] + b'{"half": 1}\n' + more)  # the tail is completed
    put(logs, "c.jsonl", base["c"] + more + b'{"open')
    put(logs, "d.jsonl", base["d"].replace(b'"k": 3', b'"k": 4', 1) + more)
    put(logs, "e.jsonl", base["e"][: len(line(0, n="e")) * 4])
    put(logs, "f.jsonl", base["f"] + b"not json\n")
    put(logs, "g.jsonl", base["g"].replace(b'"k": 8', b'"k": 7', 1))  # as long as before
    put(logs, "empty.jsonl", line(1))
    put(logs, "new.jsonl", more)
    two = appends.advance(spark, str(logs), "codex", proofs, block=block, size=size)
    length = {n: os.path.getsize(logs / f"{n}.jsonl") for n in [*"abcdefgh", "empty", "new"]}
    start = {n: len(base[n]) for n in "bcf"}
    want = {"a": "unchanged", "h": "unchanged", "b": "appended", "c": "appended", "d": "rewritten", "e": "truncated", "f": "rejected", "g": "rewritten", "empty": "new", "new": "new"}
    assert texts(two.outcomes) == sorted((f"{n}.jsonl", s, start.get(n, 0), 0 if s == "unchanged" else length[n] - start.get(n, 0)) for n, s in want.items())
    put(logs, "f.jsonl", base["f"])  # what was stored of it stands
    assert plain(appends.merged(records, two)) == full(spark, logs)
    again = {r.file.rsplit("/", 1)[-1]: (r.completed_offset, r.next_ordinal) for r in two.proofs.collect()}
    assert again["c.jsonl"] == (len(base["c"] + more), 11) and again["f.jsonl"] == (len(base["f"]), 9)
    assert {s for _, s, _, _ in texts(appends.advance(spark, str(logs), "codex", two.proofs, block=block, size=size).outcomes)} == {"unchanged"}


def test_proofs_of_other_shapes_are_refused(spark, tmp_path):
    put(tmp_path, "a.jsonl", b"".join(line(k) for k in range(50)))
    one = appends.advance(spark, str(tmp_path), "codex", block=32)
    proofs = saved(one.proofs)
    for stored, block in ((proofs, 64), (proofs.withColumn("version", F.lit(0)), 32)):
        assert [s for _, s, _, _ in texts(appends.advance(spark, str(tmp_path), "codex", stored, block=block).outcomes)] == ["refused"]
    assert [s for _, s, _, _ in texts(appends.advance(spark, str(tmp_path), "codex", proofs, block=32, key=b"other").outcomes)] == ["rewritten"]


@pytest.mark.parametrize("n", [2, 31, 32, 33, 700])
def test_one_byte_anywhere_changes_the_root(spark, tmp_path, n):
    rng = random.Random(n)
    content = bytes(rng.randrange(256) for _ in range(n))
    variants = [content] + [content[:k] + bytes([content[k] ^ 1]) + content[k + 1 :] for k in sorted({0, n // 2, n - 1}) if 0 <= k < n] + [content + b"\0"] + ([content[:-1]] if n else [])
    for k, v in enumerate(variants):
        (tmp_path / f"{k}.jsonl").write_bytes(v)
    files = appends.listing(spark, str(tmp_path), "codex").withColumn("old_length", F.lit(0).cast("long"))
    root = {}
    for block, fanout in ((32, 2), (32, 256), (64, 256)):
        found = appends.roots(files, appends.leaves(files, block), block, fanout).where("which = 'new'").join(files.select("source_id", "file"), "source_id").collect()
        root[block, fanout] = {r.root for r in found}
        assert len(root[block, fanout]) == len(variants)
    assert not root[32, 2] & root[32, 256] and not root[64, 256] & root[32, 256]


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_ranges_give_each_line_once(spark, tmp_path, size):
    rng = random.Random(size)
    parts = [rng.choice([line(k), line(k, t="x" * rng.randrange(60)), b"\n", b"\r\n", b"  \n", line(k)[:-1] + b"\r\n", line(k, t="é😀")]) for k in range(40)]
    put(tmp_path, "a.jsonl", b"\xef\xbb\xbf" + b"".join(parts) + b'{"tail')
    content = (tmp_path / "a.jsonl").read_bytes()
    files = appends.listing(spark, str(tmp_path), "codex").withColumn("start", F.lit(0).cast("long"))
    got = sorted((r.byte_offset, r.next_offset, r.raw, r.code) for r in appends.lines_from(files, size).collect())
    assert got == [(at, end, text, code) for _, at, end, text, code in jsonl.lines(content)]


def test_long_lines(spark, tmp_path):
    put(tmp_path, "a.jsonl", line(1) + b'"' + b"x" * (3 << 20) + b'"\n' + line(2) + b"y" * (2 << 20))
    files = appends.listing(spark, str(tmp_path), "codex").withColumn("start", F.lit(0).cast("long"))
    for size in (1 << 19, 1 << 26):
        got = sorted((r.byte_offset, r.code) for r in appends.lines_from(files, size).collect())
        assert [c for _, c in got] == [None, "RECORD_TOO_LARGE", None, "PENDING_TAIL"]


def test_ranges_are_many_tasks(spark, tmp_path):
    for k in range(12):
        put(tmp_path, f"{k}.jsonl", line(k) * 3)
    files = saved(appends.listing(spark, str(tmp_path), "codex").withColumns({"start": F.lit(0).cast("long"), "old_length": F.lit(0).cast("long")}))
    for rows in (appends.lines_from(files), appends.leaves(files)):
        assert rows.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_short_lines_are_not_copied_with_their_buffer():
    began, n = time.monotonic(), 1_000_000
    f = io.BytesIO(b"{}\n" * n)
    assert sum(1 for _ in appends._line_starts(f, 0, 3 * n, 3 * n, jsonl.LINE_LIMIT)) == n
    assert time.monotonic() - began < 10
