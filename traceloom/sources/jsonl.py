"""JSON-lines logs as records with byte offsets.

Files are read with Spark's ``text`` source, so any store that Spark reaches will do, and
a file of any size is read in blocks by many tasks. Lines end in LF; one CR before it is
dropped; a byte-order mark counts only at offset 0. The bytes after the last LF are
pending and not parsed.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.functions.saved import saved

LINE_LIMIT = 1 << 20
#: Places are counted from the first line of a block of a file, records from its first record.
_PLACED = "source_id string, length long, block long, place long, next_place long, number long, raw string, code string"
_ARROW = pa.schema([("source_id", pa.string()), ("length", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("next_place", pa.int64()), ("number", pa.int64()), ("raw", pa.string()), ("code", pa.string())])


def _parsed(line: bytes, line_limit: int) -> tuple[str | None, str | None]:
    """Text and code of a line without its LF; both null if it is blank."""
    line = line.removesuffix(b"\r")
    if len(line) > line_limit:
        return None, "RECORD_TOO_LARGE"
    if not line.strip():
        return None, None
    try:
        text = line.decode("utf-8")
        return (text, None) if isinstance(json.loads(text), dict) else (None, "RECORD_NOT_OBJECT")
    except UnicodeDecodeError:
        return None, "INVALID_UTF8"
    except (ValueError, RecursionError):
        return None, "INVALID_JSON"


def lines(content: bytes, line_limit: int = LINE_LIMIT):
    """(ordinal, offset, next offset, text, code): text is null where code says what is wrong with the line."""
    at, ordinal = 0, 0
    while True:
        end = content.find(b"\n", at)
        if end < 0:
            if at < len(content):
                yield None, at, len(content), None, "PENDING_TAIL"
            return
        line = content[at:end]
        if at == 0 and line.startswith(b"\xef\xbb\xbf"):
            line = line[3:]
        text, code = _parsed(line, line_limit)
        if text is not None or code:
            yield (ordinal if text is not None else None), at, end + 1, text, code
            ordinal += text is not None
        at = end + 1


def _source_id(provider: str, file: str) -> str:
    """A hash of provider and path. A file's metadata has its path escaped as in a URI, with three slashes in a store without a name."""
    return hashlib.sha256(f"{provider}\0{re.sub('^([A-Za-z][A-Za-z0-9+.-]*):///', r'\1:/', unquote(file))}".encode()).hexdigest()


def _placed(provider: str, batches):
    """Lines of a block come one after the other, so places and numbers are running sums, carried from batch to batch."""
    at, place, number = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, length, block, size, line = batch.columns
        got = [_parsed(x, LINE_LIMIT) if x is not None else (None, "RECORD_TOO_LARGE") for x in line.to_pylist()]
        texts, codes = [t for t, _ in got], [c for _, c in got]
        starts, files = block.to_numpy(zero_copy_only=False), file.dictionary_encode()
        names = files.indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((starts[1:] != starts[:-1]) | (names[1:] != names[:-1])) + 1
        if (file[0].as_py(), int(starts[0])) != at:
            place, number = 0, 0
        sums = []
        for step, before in ((size.to_numpy(zero_copy_only=False) + 1, place), (np.fromiter((t is not None for t in texts), np.int64, len(texts)), number)):
            total = np.concatenate(([0], np.cumsum(step)))
            base = np.full(len(step), -before, np.int64)  # of the block that the batch goes on with
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(step)]):
                base[a:b] = total[a]
            sums.append((total[:-1] - base, total[1:] - base))
        (places, ends), (numbers, counts) = sums
        at, place, number = (file[-1].as_py(), int(starts[-1])), int(ends[-1]), int(counts[-1])
        sources = pa.array([_source_id(provider, x) for x in files.dictionary.to_pylist()], pa.string()).take(files.indices)
        yield pa.RecordBatch.from_arrays([sources, length, block, pa.array(places), pa.array(ends), pa.array(numbers), pa.array(texts, pa.string()), pa.array(codes, pa.string())], schema=_ARROW)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Listing of the ``.jsonl`` files under a folder: path, length, modificationTime. Compressed logs aren't logs."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(folder).select("path", "length", "modificationTime")


def read_records(spark: SparkSession, folder: str, provider: str, pattern: str = "*.jsonl") -> DataFrame:
    """All lines of all logs under ``folder``: records (code null) and diagnostics (raw null).

    source_id is a hash of provider and path, so a file that moves is another source. Lines
    are read and checked once and saved; then those of blocks that don't begin their file, or
    whose file has a byte-order mark, are moved by sums over the blocks before. So that no
    line is shuffled for what is true of small logs, only such blocks are joined.
    """
    load = lambda kind: spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    size = F.octet_length("value")
    text = load("text").option("lineSep", "\n").load(folder)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("block"), size.cast("long").alias("size"), F.when(size <= LINE_LIMIT + 1, F.col("value").cast("binary")).alias("line"))
    lines = saved(text.mapInArrow(functools.partial(_placed, provider), _PLACED))
    before = W.partitionBy("source_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = lines.groupBy("source_id", "block").agg(F.max("next_place").alias("bytes"), F.count("raw").alias("records"), F.max("length").alias("_length"))
    blocks = blocks.select("source_id", "block", "_length", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "records")], F.sum("bytes").over(W.partitionBy("source_id")).alias("total"))
    # The reader takes a byte-order mark away: then lines with one LF each are shorter than the file.
    moved = blocks.select("source_id", "block", "bytes_before", "records_before", F.when(F.col("total") < F.col("_length"), 3).otherwise(0).alias("mark")).where("bytes_before > 0 OR mark > 0")
    none = F.lit(0).cast("long")
    rows = lines.join(saved(moved), ["source_id", "block"], "left").withColumns({c: F.coalesce(c, none) for c in ("bytes_before", "records_before", "mark")})
    first = F.col("bytes_before") + F.col("place")
    rows = rows.withColumn("byte_offset", F.when(first > 0, first + F.col("mark")).otherwise(0)).withColumn("next_offset", F.col("bytes_before") + F.col("next_place") + F.col("mark"))
    tail = F.col("next_offset") > F.col("length")
    rows = rows.select(
        "source_id", F.when(F.col("raw").isNotNull() & ~tail, F.col("records_before") + F.col("number")).alias("ordinal"), "byte_offset", F.least("next_offset", "length").alias("next_offset"),
        F.when(~tail, F.col("raw")).alias("raw"), F.when(tail, "PENDING_TAIL").otherwise(F.col("code")).alias("code"),
    )
    return rows.where("raw is not null or code is not null")


def admitted(records: DataFrame) -> DataFrame:
    """Records of the files in which every completed line is good: one bad line rejects its file."""
    # Saved, so that its size is known and the records needn't be shuffled for a few files.
    bad = saved(records.where("code is not null and code <> 'PENDING_TAIL'").select("source_id").distinct())
    return records.where("code is null").join(bad, "source_id", "left_anti").drop("code")


def unchanged(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources whose content digest equals the stored one, so that they need no parsing."""
    return current.join(stored, ["source_id", "content_sha256"], "left_semi")
