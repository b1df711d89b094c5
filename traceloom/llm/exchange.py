"""Exact counting of many fingerprints with a few bytes of shuffle for each.

Documents are gathered in chunks of bounded size. A chunk sends, for each bucket
of the fingerprint space, one sorted and packed list of the distinct fingerprints
it holds (the request). The bucket's task merges the lists of all chunks and
answers each chunk with one bit or byte for each fingerprint in its list, in the
list's order (the reply). Copies inside a chunk are merged before the shuffle, so a
fingerprint that is everywhere costs a row for each chunk at most, and no group of
documents ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.scratch import Scratch, partitions

CHUNK_SCHEMA = "chunk_id long, n_docs int, ids binary, id_null binary, ends binary, data binary"
REQUEST_SCHEMA = "bucket int, part int, chunk_id long, n int, keys binary, more binary"
REPLY_SCHEMA = "chunk_id long, round int, part int, bucket int, n int, flags binary"
U64 = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8")
    return np.cumsum(steps, dtype=U64)


def squeeze(blob: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(blob)


def expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


class Chunk:
    """Documents that are handled together: ids, and texts in one byte buffer."""

    def __init__(self, row: dict):
        self.chunk_id = row["chunk_id"]
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.id_null = np.frombuffer(row["id_null"], dtype=bool)
        ends = np.frombuffer(row["ends"], dtype="<i8")
        self.starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.ends = ends.astype(np.int64)
        self.data = np.frombuffer(expand(row["data"]) + bytes(8), dtype=np.uint8)[:-8]

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, type=pa.int64(), mask=self.id_null)


def _chunker(chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, nulls, texts, size = [], [], [], 0

        def close():
            ends = np.cumsum([len(t) for t in texts], dtype="<i8")
            return pa.RecordBatch.from_pydict(
                {
                    "chunk_id": pa.array([number], pa.int64()), "n_docs": pa.array([len(ids)], pa.int32()),
                    "ids": pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()), "id_null": pa.array([np.array(nulls, dtype=bool).tobytes()], pa.binary()),
                    "ends": pa.array([ends.tobytes()], pa.binary()), "data": pa.array([squeeze(b"".join(texts))], pa.binary()),
                }
            )

        for batch in batches:
            texts_here = batch.column(1).cast(pa.large_binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts_here, strict=True):
                text = text.as_py() or b""
                if ids and (size + len(text) > chunk_bytes or len(ids) == 50_000):
                    yield close()
                    number += 1
                    ids, nulls, texts, size = [], [], [], 0
                ids.append(doc or 0)
                nulls.append(doc is None)
                texts.append(text)
                size += len(text)
        if ids:
            yield close()

    return run


def chunked(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int) -> DataFrame:
    """The documents in chunks, dealt by chunk so that later steps reuse one exchange.

    A chunk that is computed again after a loss must hold the same rows, so an input whose
    order a shuffle may change is saved first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = Scratch(docs.sparkSession).save(rows, "documents")
    return rows.mapInArrow(_chunker(chunk_bytes), CHUNK_SCHEMA).repartition(partitions(docs.sparkSession), "chunk_id")


def corpus_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts: sizes of sketches and numbers of buckets follow from it."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def chunk_size(items: float, bytes_each: float) -> int:
    """Bytes of a chunk. It grows with the root of the corpus, as does a bucket, so that a list from one chunk to one bucket keeps some 64 keys; at most 32 MB, where lists get shorter, so that memory doesn't follow the corpus."""
    return min(32 << 20, max(2 << 20, int(8 * items**0.5 * bytes_each)))


def bucket_size(items: float) -> int:
    """Keys of a bucket: what one task sorts at a time."""
    return max(1 << 20, int(8 * items**0.5))


def bits_for(items: float, most: int) -> int:
    """Bits of the bucket number, so that a bucket holds about ``most`` items."""
    bits = 0
    while items > most << bits and bits < 24:
        bits += 1
    return bits


def requests(chunk_id: int, keys: np.ndarray, bits: int, width: int = 64, part: int = 0, more: np.ndarray | None = None) -> pa.RecordBatch | None:
    """The rows that a chunk sends: sorted ``width``-bit keys cut by their leading bits, and 16 or 32 more bits of each where asked for.

    Without ``more`` the keys are distinct, with it the pairs are.
    """
    if not len(keys):
        return None
    bucket = (keys >> U64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]))
    rest = keys & U64((1 << (width - bits)) - 1)
    k = len(cuts) - 1
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "part": pa.array([part] * k, pa.int32()), "chunk_id": pa.array([chunk_id] * k, pa.int64()),
            "n": pa.array(np.diff(cuts), pa.int32()), "keys": pa.array([pack(rest[a:b]) for a, b in spans], pa.binary()),
            "more": pa.array([None if more is None else more[a:b].tobytes() for a, b in spans], pa.binary()),
        }
    )


def distinct_pairs(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct pairs of two arrays, the place of each among them, and which occur twice or more."""
    distinct, first, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if (more[first[back]] == more).all():
        return distinct, more[first], back, count > 1
    order = np.lexsort((more, keys))  # equal keys with other bits: seldom
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    at = np.cumsum(new) - 1
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = at
    return keys[order][new], more[order][new], back, np.bincount(at) > 1


def repeated(lists: list[tuple[np.ndarray, np.ndarray | None]], part: int = 0) -> list[np.ndarray]:
    """For each list of distinct keys (or pairs): which of them another list holds too. Sorts one bucket."""
    keys = np.concatenate([x for x, _ in lists])
    if lists[0][1] is None:
        every = np.sort(keys)
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        if not len(twice):
            return [np.zeros(len(x), dtype=bool) for x, _ in lists]
        return [twice[np.minimum(np.searchsorted(twice, x), len(twice) - 1)] == x for x, _ in lists]
    *_, back, often = distinct_pairs(keys, np.concatenate([y for _, y in lists]))
    return np.split(often[back], np.cumsum([len(x) for x, _ in lists])[:-1])


def answer(sent: DataFrame, round_no: int, merge: Callable[[list[tuple], int], list[np.ndarray]] = repeated, as_bits: bool = True) -> DataFrame:
    """Each bucket's task runs ``merge`` on the lists of its chunks, by chunk, one bucket at a time."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id")
        more = [None if x is None else np.frombuffer(x, dtype=f"<u{len(x) // n}") for x, n in zip(table.column("more").to_pylist(), table.column("n").to_pylist(), strict=True)]
        lists = list(zip([unpack(x) for x in table.column("keys").to_pylist()], more, strict=True))
        flags = [squeeze((np.packbits(x) if as_bits else x).tobytes()) for x in merge(lists, table.column("part")[0].as_py())]
        n = table.num_rows
        return pa.table(
            {
                "chunk_id": table.column("chunk_id"), "round": pa.array([round_no] * n, pa.int32()), "part": table.column("part"),
                "bucket": table.column("bucket"), "n": table.column("n"), "flags": pa.array(flags, pa.binary()),
            }
        )

    return sent.groupBy("bucket", "part").applyInArrow(run, REPLY_SCHEMA)


def read_flags(replies: pa.Table, round_no: int, part: int = 0, as_bits: bool = True) -> np.ndarray:
    """A chunk's answers of one round, in the order of its sorted keys."""
    mine = [r for r in replies.to_pylist() if r["round"] == round_no and r["part"] == part]
    out = []
    for r in sorted(mine, key=lambda r: r["bucket"]):
        raw = np.frombuffer(expand(r["flags"]), dtype=np.uint8)
        out.append(np.unpackbits(raw, count=r["n"]).astype(bool) if as_bits else raw)
    return np.concatenate(out) if out else np.empty(0, dtype=bool if as_bits else np.uint8)


def send(chunks: DataFrame, build: Callable[[Chunk], list[pa.RecordBatch | None]]) -> DataFrame:
    """Requests that need no earlier answer."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from (x for x in build(Chunk(row)) if x is not None)

    return chunks.mapInArrow(run, REQUEST_SCHEMA)


def with_replies(chunks: DataFrame, replies: DataFrame, build: Callable[[Chunk, pa.Table], list[pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Runs ``build`` on each chunk with its answers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [x for row in left.to_pylist() for x in build(Chunk(row), right) if x is not None]
        return pa.Table.from_batches(made).cast(arrow) if made else arrow.empty_table()

    return chunks.groupBy("chunk_id").cogroup(replies.groupBy("chunk_id")).applyInArrow(run, schema)
