"""Open calls on a stream: any split gives the same, the state follows what is open, other state is refused."""

import json
import random

import pytest

from traceloom.streaming import calls

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Plain(dict):
    put, remove = dict.__setitem__, dict.pop


def call(i, s, command="pytest"):
    return {"timestamp": f"2026-01-01T00:00:{s:02}Z", "type": "response_item", "payload": {"type": "function_call", "call_id": f"c{i}", "name": "shell", "arguments": json.dumps({"command": command})}}


def result(i, s, code=0, **more):
    return {"timestamp": f"2026-01-01T00:00:{s:02}Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": f"c{i}", "output": json.dumps({"exit_code": code} | more)}}


def log():
    rows = [call(1, 1), call(1, 1), result(2, 2, 1), call(3, 3, "rg x"), call(2, 4, "rg x"), {"type": "session_meta"}, result(1, 5, None, running=True), result(3, 6, 1), result(1, 7), call(4, 8, "frobnicate"), result(4, 9, 3), call(1, 10), call(5, 11), result(5, 3)]
    return [(10 * k, json.dumps(r)) for k, r in enumerate(rows)]


def folded(parts):
    """Rows by id and offset after several parts, with the same maps."""
    held, early, out = Plain(), Plain(), {}
    for part in parts:
        for row in calls.executions("s", iter(part), held, early):
            out[row[1:3]] = row
    return out, held, early


def test_any_split_gives_the_same():
    rows = log()
    whole, held, early = folded([rows])
    assert {k: v[7:9] for k, v in whole.items()} == {("c1", 0): ("completed", "success"), ("c3", 30): ("completed", "no_match"), ("c2", 40): ("completed", "no_match"), ("c4", 90): ("unknown", "unknown"), ("c1", 110): ("pending", "unknown"), ("c5", 120): ("completed", "success")}
    assert whole["c5", 120][5:7] == (None, None)  # it would end before it began
    assert set(held) == {"c1"} and not early
    for k in range(len(rows)):
        assert folded([rows[:k], rows[k:]])[0] == whole
    assert folded([[r] for r in rows])[0] == whole


def test_seals():
    sealer = calls.Sealer(b"k")
    entry = sealer.close("s/calls/c1", {"at": 1})
    assert sealer.open("s/calls/c1", entry) == {"at": 1}
    version, seal, body = entry
    for other, place, changed in ((calls.Sealer(b"other"), "s/calls/c1", entry), (calls.Sealer(b"k", 2), "s/calls/c1", entry), (sealer, "s/calls/c2", entry), (sealer, "s/calls/c1", (version, seal, body.replace("1", "2"))), (sealer, "s/calls/c1", (version, "0" * 64, body))):
        with pytest.raises(calls.RefusedState):
            other.open(place, changed)


def drive(spark, folder, out, key, version=1):
    """All files of a folder, one micro-batch for each; the last batch's number of state rows."""
    got = []

    def take(df, n):
        got.extend(map(tuple, df.collect()))  # of one source in the order of its records

    stream = spark.readStream.schema("source_id string, byte_offset long, raw string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = calls.open_calls(stream, key, version).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return got, q.lastProgress


def test_stream_equals_batch_and_refuses_other_state(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        rows = log()
        cuts = sorted(random.Random(1).sample(range(1, len(rows)), 3))
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            spark.createDataFrame([(s, *r) for s in ("s", "t") for r in rows[a:b]], "source_id string, byte_offset long, raw string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n}"))
        for n in range(4):  # one file after the other, in order
            for f in (tmp_path / "in" / f"{n}").glob("part-*.parquet"):
                (tmp_path / "flat").mkdir(exist_ok=True)
                f.rename(tmp_path / "flat" / f"{n}.parquet")
                import os

                os.utime(tmp_path / "flat" / f"{n}.parquet", (1000 + n, 1000 + n))
        got, progress = drive(spark, tmp_path / "flat", tmp_path / "check", b"k")
        last = {v[:3]: v for v in got}
        whole, _, _ = folded([rows])
        assert {k[1:]: v[1:] for k, v in last.items() if k[0] == "s"} == {k: v[1:] for k, v in whole.items()}
        assert {k[1:]: v[1:] for k, v in last.items() if k[0] == "t"} == {k: v[1:] for k, v in whole.items()}
        assert progress["stateOperators"][0]["numRowsTotal"] == 2  # the call that is open, of each source
        more = spark.createDataFrame([("s", 999, json.dumps(result(1, 20)))], "source_id string, byte_offset long, raw string")
        more.coalesce(1).write.mode("append").parquet(str(tmp_path / "flat"))
        for key, version in ((b"other", 1), (b"k", 2)):
            with pytest.raises(Exception, match="RefusedState|seal|version"):
                drive(spark, tmp_path / "flat", tmp_path / "check", key, version)
        got, _ = drive(spark, tmp_path / "flat", tmp_path / "check", b"k")
        assert [v[7] for v in got] == ["completed"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
