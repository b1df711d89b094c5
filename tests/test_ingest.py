"""Line reader, and that files of any size give their lines."""

import json

from test_pairing import log

from traceloom.operators import pairing
from traceloom.sources import jsonl


def test_lines():
    got = list(jsonl.lines('﻿{"a":"é"}\r\n\nnot json\n[1]\n{"b":2}\n{"c"'.encode()))
    assert [(o, at, code) for o, at, _, _, code in got] == [(0, 0, None), (None, 16, "INVALID_JSON"), (None, 25, "RECORD_NOT_OBJECT"), (1, 29, None), (None, 37, "PENDING_TAIL")]
    assert [c for *_, c in jsonl.lines(b"\xff\xfe{}\n")] == ["INVALID_UTF8"]
    assert [c for *_, c in jsonl.lines(b'{"a":"' + b"x" * 50 + b'"}\n', line_limit=20)] == ["RECORD_TOO_LARGE"]
    assert list(jsonl.lines(b"")) == []


def test_files_to_events(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name in "ab":
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in log()))
    (folder / "bad.jsonl").write_text('{"type":"x"}\nbroken\n')
    (folder / "c.jsonl.gz").write_text("not a log")
    assert jsonl.discover(spark, str(folder)).count() == 3
    records = jsonl.admitted(jsonl.read_records(spark, str(folder), "codex"))
    assert records.select("source_id").distinct().count() == 2
    assert pairing.codex_executions(pairing.codex_facts(records)).count() == 2 * 10


def test_blocks_give_the_lines_of_the_whole_file(spark, tmp_path):
    """Files read in blocks of a few hundred bytes: byte-order mark, CR, blank, bad and pending lines, names with spaces."""
    good = "".join(json.dumps(r) + ("\r\n" if k % 3 else "\n\n") for k, r in enumerate(log() * 4)).encode()
    bom = b"\xef\xbb\xbf"
    contents = {
        "plain": good, "mark": bom + good, "mark tail": bom + good + b'{"c"', "tail%20": good + b'{"a": 1}', "bad": good + b"\xff{}\n[1]\nno\n" + good, "empty": b"",
        "long": good + b'{"a":"' + b"x" * (1 << 20) + b'"}\n' + good, "limit": b'{"a":"' + b"x" * ((1 << 20) - 8) + b'"}\r\n' + good,
    }
    for name, content in contents.items():
        (tmp_path / f"{name}.jsonl").write_bytes(content)
    want = sorted(str(x) for c in contents.values() for x in jsonl.lines(c))
    sizes = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        (tmp_path / "long.jsonl").unlink(), (tmp_path / "limit.jsonl").unlink()
        few = sorted(str(x) for n, c in contents.items() if n not in ("long", "limit") for x in jsonl.lines(c))
        assert sorted(str(tuple(r)[1:]) for r in jsonl.read_records(spark, str(tmp_path), "codex").collect()) == few
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("long", "limit"):
        (tmp_path / f"{name}.jsonl").write_bytes(contents[name])
    records = jsonl.read_records(spark, str(tmp_path), "codex")
    assert sorted(str(tuple(r)[1:]) for r in records.collect()) == want
    paths = {r.path for r in jsonl.discover(spark, str(tmp_path)).collect() if "empty" not in r.path}
    import hashlib

    assert {r.source_id for r in records.select("source_id").distinct().collect()} == {hashlib.sha256(f"codex\0{x}".encode()).hexdigest() for x in paths}


def test_a_log_above_64_mib_is_read(spark, tmp_path):
    line = json.dumps({"a": "x" * 1_000_000}) + "\n"
    with open(tmp_path / "large.jsonl", "w") as f:
        for _ in range(70):
            f.write(line)
    got = jsonl.admitted(jsonl.read_records(spark, str(tmp_path), "codex")).select("ordinal", "byte_offset", "next_offset").collect()
    assert sorted(tuple(r) for r in got) == [(k, k * len(line), (k + 1) * len(line)) for k in range(70)]


def test_logs_are_written_flat_and_read_in_small_batches(spark, tmp_path):
    """One file for each source and no folder of its own; places are carried over Arrow batches, and a line is read into a record once."""
    from pyspark.sql import functions as F

    from traceloom.sources.written import write_named

    folder = tmp_path / "flat"
    rows = spark.range(200).select((F.col("id") % 7).alias("source"), "id", F.concat(F.lit('{"é":'), F.col("id").cast("string"), F.lit("}")).alias("line"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert write_named(rows, f"file://{folder}") == 7
        assert sorted(x.name for x in folder.iterdir()) == [f"source-{k}.jsonl" for k in range(7)]
        want = {k: "".join(f'{{"é":{i}}}\n' for i in range(k, 200, 7)).encode() for k in range(7)}
        assert {k: (folder / f"source-{k}.jsonl").read_bytes() for k in range(7)} == want
        (folder / "bad.jsonl").write_text('{"a":1}\n\nno\n{"b":2}\n{"c"')
        records = jsonl.read_records(spark, str(folder), "codex")
        got = sorted(str(tuple(r)[1:]) for r in records.collect())
        assert "Exchange" not in jsonl.admitted(records)._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(str(x) for c in (*want.values(), (folder / "bad.jsonl").read_bytes()) for x in jsonl.lines(c))
