"""Logs that grow: proofs of their content, and reading of what was appended only.

The content of a log is proven by a tree of digests. Leaves are fixed blocks, which any
number of tasks read and digest; the digests of 256 neighbours make one of the level
above, up to a root that also holds the length and the shape of the tree. A log that was
read before is looked at again block by block up to its old length. If its old root comes
out, what it held stands and only the lines after the last complete one are parsed, from
ranges of bytes that are tasks of their own. Files are opened by ``pyarrow.fs``, in tasks
only, so they may be in any store that it reaches.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.functions.saved import saved
from traceloom.sources.jsonl import LINE_LIMIT, _parsed

#: Bytes of a leaf, neighbours under one digest, leaves and bytes that are one task's.
BLOCK, FANOUT, STRETCH, RANGE = 1 << 20, 256, 64, 64 << 20
VERSION = 1
PROOF = "source_id string, file string, version int, block long, length long, completed_offset long, next_ordinal long, root string"
_LEAVES = "source_id string, which string, leaf long, digest string"
_LINES = "source_id string, start long, number long, byte_offset long, next_offset long, raw string, code string"
_LINE_ARROW = pa.schema([("source_id", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("byte_offset", pa.int64()), ("next_offset", pa.int64()), ("raw", pa.string()), ("code", pa.string())])


class Advance(NamedTuple):
    """What one look at a folder gives.

    ``outcomes`` has for each source: status, start (first byte parsed), parsed_bytes. ``records`` are
    the new records of sources that were read; ``proofs`` take the place of the stored ones.
    """

    outcomes: DataFrame
    records: DataFrame
    proofs: DataFrame


def listing(spark: SparkSession, folder: str, provider: str, pattern: str = "*.jsonl") -> DataFrame:
    """Logs under a folder: source_id, file, length, modified. A file without bytes isn't listed: it is no log yet."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.sha2(F.concat_ws("\x00", F.lit(provider), "path"), 256).alias("source_id"), F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def _opened(file: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file)
    return store.open_input_file(path)


def _ranges(files: DataFrame, start: Column, stop: Column, size: int, *more: str) -> DataFrame:
    """Each file's bytes from ``start`` to ``stop`` in ranges of ``size``, dealt out evenly.

    The number of tasks is named: adaptive execution would judge the ranges by the few bytes
    of their rows, not by the bytes they stand for, and put all of them in one task.
    """
    cut = files.withColumn("_n", F.greatest(F.lit(0), F.ceil((stop - start) / F.lit(float(size)))).cast("long")).where("_n > 0")
    cut = cut.select("source_id", "file", *more, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_k"), start.alias("_a"), stop.alias("_b"))
    cut = cut.select("source_id", "file", *more, (F.col("_a") + F.col("_k") * size).alias("start"), F.least(F.col("_a") + (F.col("_k") + 1) * size, "_b").alias("stop"))
    spark = files.sparkSession
    return cut.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def leaves(files: DataFrame, block: int = BLOCK, key: bytes = b"") -> DataFrame:
    """Digests of the blocks of files (source_id, file, length, old_length): ``which`` is new (up to length) or old (up to old_length).

    A byte is read once: the block in which the old length lies gives a digest of either
    length, and one before it counts for both. Where a file ends too early the digest is null.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                with _opened(r["file"]) as f:
                    f.seek(r["start"])
                    for at in range(r["start"], r["stop"], block):
                        want, data = min(block, r["length"] - at), bytearray()
                        while len(data) < want and (piece := f.read(want - len(data))):
                            data += piece
                        digest = lambda x, leaf=at // block: hmac.new(key, b"leaf" + leaf.to_bytes(8, "big") + x, hashlib.sha256).hexdigest()
                        whole = digest(data) if len(data) == want else None
                        out.append((r["source_id"], "new", at // block, whole))
                        if at < r["old_length"]:
                            short = r["old_length"] - at
                            out.append((r["source_id"], "old", at // block, whole if short >= want else digest(data[:short]) if len(data) >= short else None))
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("source_id", "which", "leaf", "digest"), zip(*out, strict=True) if out else ((),) * 4, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)})

    ranges = _ranges(files, F.lit(0).cast("long"), F.col("length"), block * STRETCH, "length", "old_length")
    return ranges.mapInArrow(run, _LEAVES)


def roots(files: DataFrame, found: DataFrame, block: int = BLOCK, fanout: int = FANOUT, key: bytes = b"") -> DataFrame:
    """The root of each file and ``which``: over length, shape of the tree and the digest at its top. Null if a leaf is.

    A level groups at most ``fanout`` digests, so no file is in one task. An empty file has a root too.
    """
    level = found.select("source_id", "which", F.col("leaf").alias("k"), "digest")
    most = files.agg(F.max(F.ceil(F.col("length") / F.lit(float(block))))).first()[0] or 0
    while most > 1:
        under = F.array_sort(F.collect_list(F.struct("k", "digest")))
        level = level.groupBy("source_id", "which", F.floor(F.col("k") / F.lit(float(fanout))).cast("long").alias("_up")).agg(under.alias("u"), F.bool_or(F.col("digest").isNull()).alias("_lost"))
        text = F.concat_ws(",", F.lit("node"), F.transform("u", lambda x: x["digest"]))
        level = level.select("source_id", "which", F.col("_up").alias("k"), F.when(~F.col("_lost"), F.sha2(text, 256)).alias("digest"))
        most = -(-most // fanout)
    wanted = files.select("source_id", F.explode(F.array(F.struct(F.lit("new").alias("which"), F.col("length").alias("n")), F.struct(F.lit("old").alias("which"), F.col("old_length").alias("n")))).alias("w")).select("source_id", "w.which", "w.n")
    tops = wanted.join(level.select("source_id", "which", "digest"), ["source_id", "which"], "left")
    from traceloom.functions.identity import hmac_sha256

    top = F.when(F.col("n") == 0, F.lit("")).otherwise(F.col("digest"))
    return tops.select("source_id", "which", hmac_sha256(key, F.concat(F.lit(f"root,{VERSION},{block},{fanout},"), F.col("n").cast("string"), F.lit(","), top)).alias("root"))


def unchanged(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources (source_id, length, root) whose proof equals the stored one, so that they need no parsing."""
    return current.join(stored.select("source_id", "length", "root"), ["source_id", "length", "root"], "left_semi")


def _line_starts(f, start: int, stop: int, length: int, limit: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, next offset, bytes) of the lines that begin in a range, with their LF; bytes are null beyond ``limit``, and the last line may lack its LF."""
    at = start
    if start > 0:  # a line begins here only if the one before has ended
        f.seek(start - 1)
        at = start - 1
        while at < length:
            piece = f.read(1 << 20)
            if not piece:
                return
            k = piece.find(b"\n")
            if k >= 0:
                at += k + 1
                break
            at += len(piece)
    # ``base`` is the offset of buffer[0], the next line begins at buffer[head]: a buffer is cut once for each piece, not for each line.
    buffer, base, head = b"", at, 0
    f.seek(at)
    while base + head < stop:
        k = buffer.find(b"\n", head)
        if k >= 0:
            yield base + head, base + k + 1, buffer[head : k + 1]
            head = k + 1
            continue
        end = base + len(buffer)
        if len(buffer) - head <= limit + 8 and end < length:
            piece = f.read(min(1 << 20, length - end))
            if not piece:
                return
            buffer, base, head = buffer[head:] + piece, base + head, 0
            continue
        if end >= length:
            if head < len(buffer):
                yield base + head, length, buffer[head:]
            return
        # Longer than a line may be: its end is looked for without keeping it.
        begun = base + head
        while end < length:
            piece = f.read(min(1 << 20, length - end))
            if not piece:
                return
            k = piece.find(b"\n")
            if k >= 0:
                yield begun, end + k + 1, None
                buffer, base, head = piece, end, k + 1
                break
            end += len(piece)
        else:
            yield begun, length, None
            return


def lines_from(files: DataFrame, size: int = RANGE, limit: int = LINE_LIMIT) -> DataFrame:
    """Lines of files (source_id, file, start, length) from ``start`` on, where a line begins: number counts the records of a range."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                number = 0
                with _opened(r["file"]) as f:
                    for at, end, line in _line_starts(f, r["start"], r["stop"], r["length"], limit):
                        if line is not None and not line.endswith(b"\n"):
                            text, code = None, "PENDING_TAIL"
                        elif line is None:
                            text, code = None, "PENDING_TAIL" if end == r["length"] and not _ends_line(f, end) else "RECORD_TOO_LARGE"
                        else:
                            text, code = _parsed(line[:-1].removeprefix(b"\xef\xbb\xbf") if at == 0 else line[:-1], limit)
                        if text is not None or code:
                            rows.append((r["source_id"], r["start"], number, at, end, text, code))
                            number += text is not None
                        if len(rows) >= 5000:
                            yield _lines(rows)
                            rows = []
            yield _lines(rows)

    return _ranges(files, F.col("start"), F.col("length"), size, "length").mapInArrow(run, _LINES)


def _ends_line(f, end: int) -> bool:
    f.seek(end - 1)
    return f.read(1) == b"\n"


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(_LINE_ARROW)
    return pa.RecordBatch.from_pydict({f.name: pa.array(c, f.type) for f, c in zip(_LINE_ARROW, columns, strict=True)}, schema=_LINE_ARROW)


def advance(spark: SparkSession, folder: str, provider: str, stored: DataFrame | None = None, pattern: str = "*.jsonl", block: int = BLOCK, size: int = RANGE, key: bytes = b"") -> Advance:
    """Looks at all logs of a folder after ``stored`` proofs (or none) and reads what is new.

    status: ``new``; ``unchanged`` (same length and root: nothing is parsed); ``appended``
    (the old root stands: only what follows the last complete line is); ``rewritten`` and
    ``truncated`` (all is parsed, and takes the place of what was stored); ``refused`` (the proof is of
    another version or block size, so it proves nothing: all is parsed); ``input_changed``
    (the file changed while it was read) and ``rejected`` (a line is bad): nothing of
    it is taken and its stored proof stays. Sources that are gone keep their proofs.
    """
    stored = spark.createDataFrame([], PROOF) if stored is None else stored
    before = saved(listing(spark, folder, provider, pattern))
    old = stored.select("source_id", F.col("length").alias("old_n"), F.col("root").alias("old_root"), "completed_offset", "next_ordinal", "version", F.col("block").alias("old_block"))
    known = before.join(old, "source_id", "left")
    fits = (F.col("version") == VERSION) & (F.col("old_block") == block)
    # The old length matters only where the file still has it.
    known = known.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("old_length", F.when(F.col("_fits") & (F.col("old_n") <= F.col("length")), F.col("old_n")).otherwise(0).cast("long"))
    tree = saved(roots(known, leaves(known, block, key), block, key=key))
    wide = tree.groupBy("source_id").agg(F.max(F.when(F.col("which") == "new", F.col("root"))).alias("root"), F.max(F.when(F.col("which") == "old", F.col("root"))).alias("seen_root"))
    met = known.join(wide, "source_id")
    same = unchanged(met, stored).select("source_id", F.lit(True).alias("_same"))
    stands = F.coalesce(F.col("seen_root") == F.col("old_root"), F.lit(False))
    status = F.when(F.col("root").isNull(), "input_changed").when(F.col("old_n").isNull(), "new").when(~F.col("_fits"), "refused").when(F.col("_same").isNotNull(), "unchanged").when(F.col("length") < F.col("old_n"), "truncated").when(stands, "appended").otherwise("rewritten")
    judged = met.join(same, "source_id", "left").withColumn("status", status)
    judged = judged.withColumns({"start": F.when(F.col("status") == "appended", F.col("completed_offset")).otherwise(0).cast("long"), "base": F.when(F.col("status") == "appended", F.col("next_ordinal")).otherwise(0).cast("long")})
    judged = saved(judged.select("source_id", "file", "length", "modified", "root", "status", "start", "base", "completed_offset", "next_ordinal"))
    read = judged.where("status NOT IN ('unchanged', 'input_changed')")
    lines = saved(lines_from(read.select("source_id", "file", "start", "length"), size))
    after = listing(spark, folder, provider, pattern).select("source_id", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    counts = lines.groupBy("source_id", "start").agg(F.count("raw").alias("n"))
    earlier = counts.select("source_id", "start", F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row for each range
    told = lines.groupBy("source_id").agg(F.count("raw").alias("_n"), F.min(F.when(F.col("code") == "PENDING_TAIL", F.col("byte_offset"))).alias("_tail"), F.bool_or(F.coalesce(F.col("code") != "PENDING_TAIL", F.lit(False))).alias("_bad"))
    ended = judged.join(told, "source_id", "left").join(after, "source_id", "left")
    moved = ~(F.col("_length").eqNullSafe(F.col("length")) & F.col("_modified").eqNullSafe(F.col("modified")))
    final = F.when(moved, "input_changed").when(F.coalesce("_bad", F.lit(False)), "rejected").otherwise(F.col("status"))
    ended = ended.withColumn("status", final).withColumn("_took", F.col("status").isin("new", "appended", "rewritten", "truncated", "refused"))
    ended = saved(ended.select("source_id", "file", "status", "start", "base", "length", "root", "_took", "_n", "_tail", F.when(F.col("status") != "unchanged", F.col("length") - F.col("start")).otherwise(0).cast("long").alias("parsed_bytes")))
    taken = ended.where("_took").select("source_id", "base")
    # Saved, so that its size is known and the lines needn't be shuffled for one row of each range.
    placed = saved(earlier.join(taken, "source_id").select("source_id", "start", (F.col("base") + F.col("before")).alias("_first")))
    records = lines.where("raw IS NOT NULL").join(placed, ["source_id", "start"])
    records = records.select("source_id", (F.col("_first") + F.col("number")).alias("ordinal"), "byte_offset", "next_offset", "raw")
    fresh = ended.where("_took").select("source_id", "file", F.lit(VERSION).alias("version"), F.lit(block).cast("long").alias("block"), "length", F.coalesce("_tail", "length").alias("completed_offset"), (F.col("base") + F.coalesce("_n", F.lit(0))).alias("next_ordinal"), "root")
    kept = stored.join(fresh.select("source_id"), "source_id", "left_anti").select(*fresh.columns)
    return Advance(ended.select("source_id", "file", "status", "start", "parsed_bytes"), records, fresh.unionByName(kept))


def merged(stored: DataFrame, step: Advance) -> DataFrame:
    """Records after a step: those of appended sources grow, those of sources that were read anew are replaced."""
    replaced = step.outcomes.where("status IN ('new', 'rewritten', 'truncated', 'refused')").select("source_id")
    return stored.join(replaced, "source_id", "left_anti").unionByName(step.records.select(*stored.columns))
