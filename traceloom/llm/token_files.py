"""Files of token ids (operator 13): bit or byte planes of fixed-size blocks, and a chunk index.

Ids of all documents stand one after the other, in the order of document ids, cut into
parts (ranges of that order, one task each) and parts into chunks of a fixed number of
ids. A chunk's ids are transposed: plane k holds bit (or byte) k of every id. Each plane is
compressed by itself with zstandard, so the high planes, which hardly change, cost next
to nothing. Two tables make up the format, both written by Spark:

``chunks``  part, chunk, n, n_bytes of each plane, planes (compressed), check (crc32 of the
            ids), and which stretch of which document each part of the chunk is
``index``   part, chunk, first (place of its first id among all), n, n_bytes

The index is small and has all that is needed to find the chunks of any range of ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.llm.hashing import LOW_BYTES, U64, span_hashes
from traceloom.llm.packing import WordTokenizer, _parcels
from traceloom.llm.scratch import Scratch, partitions

CHUNK_SCHEMA = "part int, chunk int, n int, n_bytes array<int>, planes array<binary>, check long, docs array<struct<row:long,doc_id:long,id_null:boolean,at:int,n:int,begins:boolean,ends:boolean>>"
_DOCS = pa.list_(pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("id_null", pa.bool_()), ("at", pa.int32()), ("n", pa.int32()), ("begins", pa.bool_()), ("ends", pa.bool_())]))
PIECE_SCHEMA = "part int, row long, doc_id long, chunk int, at int, n long, crc long, whole boolean"
_BYTE_BPE: dict[str, ByteTokenizer] = {}
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of visible ASCII characters.
_SEEN = np.zeros(256, dtype=bool)
_SEEN[33:127] = True
_ALNUM = np.array([chr(c).isalnum() for c in range(128)] + [False] * 128)
_MARK = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])


class ByteTokenizer(WordTokenizer):
    """Token ids of many texts at once, for byte-level BPE whose words begin with their space.

    Such a tokenizer never joins a visible character with white space after it, nor a
    letter or digit with a mark after it. So a text's ids are those of its parts: white
    space with what follows it up to a mark, then the mark and what follows that.
    Where the character before a place isn't plain (ASCII or one of the letters up to
    U+00FF) the text isn't cut, which only makes parts longer. Parts repeat; the table
    holds their ids.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        super().__init__(path, most)
        state = self.tokenizer.pre_tokenizer
        if type(state).__name__ != "ByteLevel" or state.add_prefix_space or self.tokenizer.normalizer is not None:
            raise ValueError("this needs a byte-level tokenizer that adds no space and changes no text")

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids([p.decode() for p in parts])
        count = np.array([len(x) for x in found], dtype=np.int64)
        ids = np.empty(int(count.sum()), dtype=np.uint32)
        at = 0
        for x in found:
            ids[at : at + len(x)] = x
            at += len(x)
        return ids, count

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        long_ = np.flatnonzero(ends - starts > 256)
        if not len(long_):
            return super()._look_up(data, starts, ends)
        # A part as long as that won't come again: it isn't kept by its fingerprint.
        short = np.flatnonzero(ends - starts <= 256)
        rows = np.empty(len(starts), dtype=np.int64)
        rows[short] = super()._look_up(data, starts[short], ends[short])
        raw = data.tobytes()
        flat, count = self._encoded([raw[starts[i] : ends[i]] for i in long_.tolist()])
        rows[long_] = np.arange(len(long_)) + len(self.count)
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count) - count))
        self.count, self.ids, self.check = np.concatenate((self.count, count)), np.concatenate((self.ids, flat)), np.concatenate((self.check, np.zeros((len(long_), 3), U64)))
        return rows

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by ``end_id``, and where each text's ids end."""
        stops = np.cumsum([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts) + bytes(9), dtype=np.uint8)
        size = int(stops[-1]) if len(texts) else 0
        raw, white = data[:size], _WHITE[data[:size]]
        # Letters up to U+00FF are two bytes, the first 0xC3; the signs among them are no letters.
        latin = np.zeros(size, dtype=bool)
        latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        cut = np.zeros(size + 1, dtype=bool)
        cut[1:size] = (_SEEN[raw[:-1]] | latin[:-1]) & white[1:]
        cut[1:size] |= (_ALNUM[raw[:-1]] | latin[:-1]) & _MARK[raw[1:]]
        special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))  # where a special token may begin: such a word is left whole
        if len(special):
            gaps = np.concatenate(([-1], np.flatnonzero(white), [size]))
            for k in np.unique(np.searchsorted(gaps, special)).tolist():
                cut[gaps[k - 1] + 2 : gaps[k]] = False
        cut[stops[stops < size]] = True
        cut[0] = cut[size] = False
        edges = np.concatenate(([0], np.flatnonzero(cut), [size])) if size else np.zeros(1, np.int64)
        starts, ends = edges[:-1], edges[1:]
        rows = self._look_up(data, starts, ends) if len(starts) else np.empty(0, np.int64)
        count, first = self.count[rows], self.first[rows]
        after = np.cumsum(count)
        text_ends = np.concatenate(([0], after))[np.searchsorted(ends, stops, side="right")] if len(starts) else np.zeros(len(texts), np.int64)
        ids = self.ids[np.repeat(first - (after - count), count) + np.arange(after[-1])] if len(starts) else np.empty(0, np.uint32)
        if len(self.ids) > 16 << 20:  # long parts have filled the table
            self._forget()
        if end_id is not None:
            ids = np.insert(ids, text_ends, np.uint32(end_id))
            text_ends = text_ends + np.arange(1, len(texts) + 1)
        return ids, text_ends


def tokenizer(path: str) -> ByteTokenizer:
    """One for each worker process and file."""
    if path not in _BYTE_BPE:
        _BYTE_BPE[path] = ByteTokenizer(path)
    return _BYTE_BPE[path]


def to_planes(ids: np.ndarray, unit: str = "byte") -> list[bytes]:
    """The compressed planes of a block: plane k holds bit or byte k of each id, lowest first."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    planes = raw.T if unit == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    squeeze = zstandard.ZstdCompressor(level=3)
    return [squeeze.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids again; 4 planes are bytes, 32 are bits."""
    raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), dtype=np.uint8) for p in planes]
    if len(raw) == 4:
        return np.ascontiguousarray(np.stack(raw, axis=1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in raw], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class _Writer:
    """Cuts the ids of a part into chunks; holds one chunk and the documents that lie in it."""

    def __init__(self, part: int, block: int, unit: str):
        self.part, self.block, self.unit = part, block, unit
        self.chunk = self.row = self.held = 0
        self.ids: list[np.ndarray] = []
        self.docs: list[dict] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(ids):
            n = min(self.block - self.held, len(ids) - at)
            self.docs.append({"row": self.row, "doc_id": doc_id or 0, "id_null": doc_id is None, "at": self.held, "n": n, "begins": at == 0, "ends": at + n == len(ids)})
            self.ids.append(ids[at : at + n])
            self.held += n
            at += n
            if self.held == self.block:
                yield self.close()
        self.row += 1

    def close(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids).astype("<u4")
        one = {"part": pa.array([self.part], pa.int32()), "chunk": pa.array([self.chunk], pa.int32()), "n": pa.array([len(ids)], pa.int32())}
        planes = to_planes(ids, self.unit)
        one |= {"n_bytes": pa.array([[len(p) for p in planes]], pa.list_(pa.int32())), "planes": pa.array([planes], pa.list_(pa.binary())), "check": pa.array([zlib.crc32(ids)], pa.int64()), "docs": pa.array([self.docs], _DOCS)}
        self.chunk, self.held, self.ids, self.docs = self.chunk + 1, 0, [], []
        return pa.RecordBatch.from_pydict(one)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, block: int = 1 << 17, unit: str = "byte", parts: int | None = None) -> None:
    """Encodes every whole text, adds ``end_id`` and writes the files, in ascending order of ids.

    Ids are cast to long; null ids come first, rows that share an id by their texts; a
    null text is empty and has one token, the end. ``block`` ids are a chunk, ``unit`` is
    byte or bit. Rows are dealt by ranges of id and of a digest of the text, so that many
    rows of one id are many tasks; rows that also share the text stream through one. A
    task holds one parcel of texts and one chunk.
    """
    if unit not in ("byte", "bit"):
        raise ValueError("unit is byte or bit")
    if block < 8 or block % 8:
        raise ValueError("block is a multiple of 8")

    def run(batches):
        from pyspark import TaskContext

        mine, writer = tokenizer(tokenizer_path), _Writer(TaskContext.get().partitionId(), block, unit)
        for ids, texts in _parcels(batches):
            flat, ends = mine.encode(texts, end_id)
            for doc, low, high in zip(ids, [0, *ends.tolist()], ends.tolist(), strict=False):
                yield from writer.add(doc, flat[low:high])
        if writer.held:
            yield writer.close()

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key"))
    dealt = rows.repartitionByRange(parts or partitions(spark), F.col("id").asc_nulls_first(), "key")
    placed = dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "key", "text").select("id", "text")
    placed.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(f"{path}/chunks")
    chunks = _chunks(spark, path)
    by_part = W.partitionBy("part").orderBy("chunk")
    sizes = chunks.groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row for each part
    index = chunks.select("part", "chunk", "n", "n_bytes").withColumn("inside", F.sum(F.col("n").cast("long")).over(by_part) - F.col("n")).join(F.broadcast(before), "part")
    index.select("part", "chunk", (F.col("before") + F.col("inside")).alias("first"), "n", "n_bytes").write.parquet(f"{path}/index")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, chunk int, first long, n int, n_bytes array<int>").parquet(f"{path}/index")


def _decoded(row: dict) -> np.ndarray:
    ids = from_planes(row["planes"], row["n"])
    if len(ids) != row["n"] or zlib.crc32(ids) != row["check"]:
        raise ValueError(f"part {row['part']}, chunk {row['chunk']} is damaged")
    return ids


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for k in range(32):
        if vector >> k & 1:
            out ^= matrix[k]
    return out


def crc_of_zeros() -> list[list[int]]:
    """Matrices over GF(2): the k-th carries a crc32 over 2**k zero bytes."""
    bit = [0xEDB88320] + [1 << k for k in range(31)]  # fixed value: the polynomial of crc32, reflected
    power, out = bit, []
    for _ in range(3):  # from one bit to a byte
        power = [_times(power, x) for x in power]
    for _ in range(48):
        out.append(power)
        power = [_times(power, x) for x in power]
    return out


_ZEROS: list[list[list[int]]] = []


def joined_crc(first: int, second: int, n_second: int) -> int:
    """The crc32 of two byte strings in a row, from those of each and the length of the second."""
    if not _ZEROS:
        _ZEROS.append(crc_of_zeros())
    k = 0
    while n_second:
        if n_second & 1:
            first = _times(_ZEROS[0][k], first)
        n_second >>= 1
        k += 1
    return first ^ second


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32.

    Chunks are read in any order by any number of tasks. A document that lies in one
    chunk is done there; of longer ones each chunk gives a piece, and the checksums of a
    document's pieces are joined in order.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ids = _decoded(row)
                for d in row["docs"]:
                    piece = ids[d["at"] : d["at"] + d["n"]]
                    rows.append((row["part"], d["row"], None if d["id_null"] else d["doc_id"], row["chunk"], d["at"], d["n"], zlib.crc32(piece), d["begins"] and d["ends"]))
            columns = zip(*rows, strict=True) if rows else ((),) * 8
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            names = ("part", "row", "doc_id", "chunk", "at", "n", "crc", "whole")
            yield pa.RecordBatch.from_pydict({name: pa.array(c, kind) for name, c, kind in zip(names, columns, kinds, strict=True)})

    @F.arrow_udf("long")
    def join(pieces: pa.Array) -> pa.Array:
        out = []
        for document in pieces:
            crc = 0
            for p in document.as_py():
                crc = joined_crc(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        return pa.array(out, pa.int64())

    scratch = Scratch(spark)
    pieces = scratch.save(_chunks(spark, path).mapInArrow(run, PIECE_SCHEMA), "pieces")
    index = _index(spark, path).select("part", "chunk", "first")
    whole = pieces.where("whole").select("part", "chunk", "at", "doc_id", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = pieces.where("NOT whole").groupBy("part", "row").agg(
        F.min_by(F.struct("chunk", "at", "doc_id"), "chunk").alias("head"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("chunk", "n", "crc"))).alias("pieces")
    )
    cut = cut.select("part", "head.chunk", "head.at", "head.doc_id", "n_tokens", join("pieces").alias("ids_crc32"))
    return whole.unionByName(cut).join(index, ["part", "chunk"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The ids at places ``start`` to ``stop`` of all, as rows (first, ids); the index tells which chunks to read."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(0, start - row["first"]), min(row["n"], stop - row["first"])
                ids = _decoded(row)[a:b]
                yield pa.RecordBatch.from_pydict({"first": pa.array([row["first"] + a], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})

    mine = _index(spark, path).where((F.col("first") < stop) & (F.col("first") + F.col("n") > start)).select("part", "chunk", "first")
    return _chunks(spark, path).drop("docs").join(mine, ["part", "chunk"]).mapInArrow(run, "first long, ids array<long>")


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = Scratch(spark).path("tokens")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)


QUERIES = {"op13_token_files": op13_token_files}
ORACLES: dict[str, str] = {}
