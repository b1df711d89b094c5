"""WARC archives as chunked record tables (operator 4).

A payload of any size is handled as rows of record id, chunk number and bytes. On the
way out each chunk is one WARC record: the first is the response, later ones are
continuation records, which WARC 1.1 has for payloads too long for one record. Spark's
text writer puts the records into files, so archives go wherever Spark can write.

On the way in, Spark's text reader hands out an archive line by line, whatever store it
lies in and however many gzip members it has. A task puts the lines through a reader
that holds one header and one piece of a body at a time, and carries the digest of a
record from piece to piece. Only payloads in several records go through a shuffle, as
rows of record, segment, piece and bytes, and are digested in that order. No task holds
an archive or a payload whole.
"""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.scratch import Scratch, looked_up, partitions

PARSED = "page_id long, group_id string, record_id string, record_type string, refers_to long, refers_to_record string, payload_bytes long, digest string, segment int, piece int, total long, url string, found_bytes long, found_digest string, data binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, url string, n_chunks int, intact boolean"
_END = "\r\n\r\n"
#: Record types that carry a payload or stand for one.
_KINDS = ("response", "resource", "revisit", "conversion", "continuation")


def record_chunks(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url", smallest: int = 100, chunk_bytes: int = 256 << 10) -> DataFrame:
    """The chunked record table: page_id, record_id, record_type, refers_to, refers_to_record, payload_bytes, digest, chunk, chunks, url, data.

    Of rows with equal payloads of ``smallest`` bytes or more the one with the smallest
    page id carries the payload; the others revisit it and have one chunk without bytes.
    Null payloads are empty. Rows with the same id and payload all carry it. A row with a
    null id never is the one referred to; if no row of a payload has an id, all carry it.
    A record's id follows from page id and payload, so a revisit can name it. Ids are cast to long.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("digest", F.sha2("data", 256)).withColumn("payload_bytes", F.octet_length("data").cast("long"))
    shared = rows.where(F.col("payload_bytes") >= smallest).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = looked_up(rows, shared, ["digest"], "n", pages.count())
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select(
        "page_id", F.coalesce(_record_id("page_id"), F.concat(F.lit("urn:uuid:"), F.uuid())).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"), F.when(again, _record_id("first")).alias("refers_to_record"), "payload_bytes", "digest", "url", F.when(again, F.lit(b"")).otherwise(F.col("data")).alias("data"),
    )
    rows = rows.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / chunk_bytes)).cast("int"))
    # Rows with one id and payload have one record id; their chunks are told apart by a group.
    cut = rows.withColumn("group_id", F.when(F.col("chunks") > 1, F.uuid())).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return cut.withColumn("data", F.substring("data", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))


def _record_id(page: str) -> F.Column:
    """A version-8 UUID from page id and payload; null for a null id."""
    h = F.md5(F.concat_ws(":", F.col(page).cast("string"), F.col("digest")))
    part = lambda at, n: F.substring(h, at, n)
    return F.when(F.col(page).isNotNull(), F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12)))


def write_archives(chunks: DataFrame, folder: str, date: str | None = None, records_per_file: int = 2000) -> None:
    """Writes the chunk table as gzipped WARC 1.1 files, one record for each chunk. ``date`` is now unless given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def field(name: str, value) -> F.Column:
        return F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))

    def id_field(name: str, value) -> F.Column:
        return field(name, F.concat(F.lit("<"), value, F.lit(">")))

    first, several = F.col("chunk") == 0, F.col("chunks") > 1
    own_id = F.when(first, F.col("record_id")).otherwise(F.concat(F.lit("urn:uuid:"), F.uuid()))
    last = several & (F.col("chunk") == F.col("chunks") - 1)
    head = F.concat_ws(
        "", F.lit("WARC/1.1"),
        field("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        id_field("WARC-Record-ID", own_id), field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("record_type") == "revisit", F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        id_field("WARC-Refers-To", F.col("refers_to_record")),
        F.when(several, field("WARC-Segment-Number", F.col("chunk") + 1)),
        F.when(~first, id_field("WARC-Segment-Origin-ID", F.col("record_id"))),
        F.when(last, field("WARC-Segment-Total-Length", F.col("payload_bytes"))),
        field("X-Segment-Group", F.col("group_id")),
        field("X-Page-Id", F.col("page_id")), field("X-Refers-To-Page-Id", F.col("refers_to")), field("X-Payload-Length", F.col("payload_bytes")),
        F.lit("\r\nContent-Type: text/html"), field("Content-Length", F.octet_length("data")), F.lit(_END),
    )
    record = F.concat(head.cast("binary"), F.col("data")).cast("string")
    chunks.select(record.alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


class ArchiveReader:
    """Takes an archive's bytes in pieces of any size and yields rows of PARSED.

    A record by itself is one row, with its length and digest. A record that is a segment is
    rows of up to ``step`` bytes. The headers of this module (X-...) may be missing. Records
    without a payload, such as requests, yield nothing. HTTP headers are no part of a payload.
    """

    def __init__(self, step: int = 1 << 20, most_header: int = 1 << 20):
        self.step, self.most_header = step, most_header
        self.held, self.fields = bytearray(), None

    def _header(self) -> bool:
        """Takes the next record's header off what is held, if all of it is there."""
        while self.held[:2] == b"\r\n":
            del self.held[:2]
        end = self.held.find(b"\r\n\r\n")
        if end < 0:
            if len(self.held) > self.most_header:
                raise ValueError("no end of a record header")
            return False
        lines = bytes(self.held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.left, self.size, self.piece = int(self.fields["content-length"]), 0, 0
        del self.held[: end + 4]
        self.wanted = self.fields.get("warc-type") in _KINDS
        self.segment = self.fields.get("warc-segment-number")
        self.in_http = self.fields.get("content-type", "").startswith("application/http") and self.segment in (None, "1")
        self.digest, self.part = hashlib.sha256(), bytearray()
        return True

    def _row(self, found: bytes | None) -> tuple:
        f = self.fields
        number = lambda name: int(f[name]) if name in f else None
        plain = lambda name: f[name].strip("<>") if name in f else None
        origin = plain("warc-segment-origin-id") or plain("warc-record-id")
        digest = f.get("warc-payload-digest")
        if digest and digest.lower().startswith("sha256:"):
            digest = digest[7:].lower()
        alone = self.segment is None
        return (
            number("x-page-id"), f.get("x-segment-group", origin), origin, f["warc-type"], number("x-refers-to-page-id"), plain("warc-refers-to"), number("x-payload-length"), digest,
            None if alone else int(self.segment), None if alone else self.piece, number("warc-segment-total-length"), f.get("warc-target-uri"), self.size if alone else len(found), self.digest.hexdigest() if alone else None, found,
        )

    def _body(self, piece: bytes):
        if self.in_http:
            self.part += piece
            end = self.part.find(b"\r\n\r\n")
            if end < 0:
                if len(self.part) > self.most_header:
                    raise ValueError("no end of an HTTP header")
                return
            piece, self.in_http = bytes(self.part[end + 4 :]), False
            self.part.clear()
        self.size += len(piece)
        if self.segment is None:
            self.digest.update(piece)
            return
        self.part += piece
        while len(self.part) >= self.step:
            yield self._row(bytes(self.part[: self.step]))
            del self.part[: self.step]
            self.piece += 1

    def feed(self, piece: bytes):
        self.held += piece
        while self.fields is not None or self._header():
            take = min(self.left, len(self.held), self.step)
            if take:
                self.left -= take
                if self.wanted:
                    yield from self._body(bytes(self.held[:take]))
                del self.held[:take]
            if not self.left:
                if self.wanted and (self.segment is None or self.part or not self.piece):
                    yield self._row(None if self.segment is None else bytes(self.part))
                self.fields = None
            elif not self.held:
                return

    def close(self) -> None:
        if self.fields is not None or self.held.strip():
            raise ValueError("the archive ends within a record")


def _parse(batches):
    """Lines of archives, each archive's in order, to rows of PARSED."""
    schema = _arrow(PARSED)

    def out(rows):
        return pa.RecordBatch.from_pydict({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)}, schema=schema)

    file, reader, rows, size = None, None, [], 0
    for batch in batches:
        codes = batch.column("file").dictionary_encode()
        names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if names[codes[a]] != file:
                if reader:
                    reader.close()
                file, reader = names[codes[a]], ArchiveReader()
            lines = batch.column("line").slice(a, b - a)
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), b"\n")[0].as_buffer()
            for piece in (*(joined[k : k + (1 << 20)] for k in range(0, len(joined), 1 << 20)), b"\n"):
                for row in reader.feed(memoryview(piece)):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
    if reader:
        reader.close()
    yield out(rows)


def _digest_of(claimed: str | None, found: str) -> bool | None:
    """Whether a stated SHA-256 holds; null if another kind of digest is stated, or none."""
    return claimed == found if claimed and ":" not in claimed else None


def _join_segments(batches):
    """Rows come by group, segment and piece. The digest of an open payload is carried on, also from batch to batch."""
    schema = _arrow(RECORDS)
    first, state, size, segment, piece, total = None, None, 0, 0, 0, None

    def finish() -> list[tuple]:
        if first is None:
            return []
        if total is None or total != size:
            raise ValueError(f"{first['record_id']}: a segment is missing")
        digest = state.hexdigest()
        return [(first["page_id"], size, digest, first["record_type"], None, first["record_id"], None, first["url"], segment, _digest_of(first["digest"], digest))]

    def out(rows):
        return pa.RecordBatch.from_pydict({f.name: pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)}, schema=schema)

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if first is None or r["group_id"] != first["group_id"]:
                rows += finish()
                first, state, size, segment, piece, total = r, hashlib.sha256(), 0, 0, 0, None
            if (r["segment"], r["piece"]) not in ((segment + 1, 0), (segment, piece + 1)):
                raise ValueError(f"{r['record_id']}: segment {segment + 1} is missing")
            state.update(r["data"])
            size, segment, piece, total = size + len(r["data"]), r["segment"], r["piece"], r["total"]
        yield out(rows)
    yield out(finish())


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each payload or revisit in the archives, its length and digest taken from the bytes read.

    Archives may be gzip files of one or many members, or plain ones, of this module or of
    others. ``n_chunks`` is the number of records of a payload. ``intact`` says whether bytes
    equal what the header states, and is null where it states nothing that is checked. An
    archive that ends within a record, and a missing segment, are errors.
    """
    lines = spark.read.option("lineSep", "\n").text(folder).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"))
    packed = F.col("file").endswith(".gz")
    parsed = lines.where(packed).select("line", "file").mapInArrow(_parse, PARSED)
    if not spark.read.format("binaryFile").load(folder).select("path").where(~F.col("path").endswith(".gz")).isEmpty():
        # A plain file is read in blocks, which are put in order.
        plain = lines.where(~packed).repartition(partitions(spark), "file").sortWithinPartitions("file", "_at", "_n")
        parsed = parsed.unionByName(plain.select("line", "file").mapInArrow(_parse, PARSED))
    revisit = F.col("record_type") == "revisit"
    same = F.when(~F.col("digest").contains(":"), F.col("digest") == F.col("found_digest")) & F.coalesce(F.col("payload_bytes") == F.col("found_bytes"), F.lit(True))
    alone = parsed.where(F.col("segment").isNull()).select(
        "page_id", F.when(revisit, F.coalesce("payload_bytes", F.lit(0))).otherwise(F.col("found_bytes")).cast("long").alias("payload_bytes"), F.when(revisit, F.col("digest")).otherwise(F.col("found_digest")).alias("payload_digest"),
        "record_type", "refers_to", "record_id", "refers_to_record", "url", F.lit(1).alias("n_chunks"), F.when(revisit, F.col("found_bytes") == 0).otherwise(same).alias("intact"),
    )
    parts = parsed.where(F.col("segment").isNotNull()).repartition(partitions(spark), "group_id").sortWithinPartitions("group_id", "segment", "piece")
    return alone.unionByName(parts.mapInArrow(_join_segments, RECORDS))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = Scratch(spark).path("warc")
    write_archives(record_chunks(pages), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_chunks", "intact")


_ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to,
  CAST(CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 1 ELSE greatest(1, (payload_bytes + 262143) // 262144) END AS INTEGER) AS n_chunks,
  true AS intact
FROM g
"""

QUERIES = {"op4_warc": op4_warc}
ORACLES = {"op4_warc": _ORACLE}
