"""Removal of repeated byte strings (operator 2), with a difference cover in place of whole suffixes.

Suffixes need to be told apart for ``length`` bytes only. Two suffixes that agree for
that long agree, at one offset below the cover's period, in a suffix that both have in
the cover sample. So the sample's fingerprints are grouped first, one bucket at a time;
a sampled place whose fingerprint another has too is tied. A suffix none of whose sampled
offsets is tied is alone and is not looked at again. The rest, the long ties, are grouped
by fingerprints of their first ``length`` bytes, again one bucket at a time. Memory is
that of one bucket, whose size is a parameter.

Nothing is put in the alphabet's order and no ranks are given: only equality within the
length matters for the result. The README says why.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from traceloom.llm import exchange as X
from traceloom.llm import hashing as H
from traceloom.llm.substring_dedup import covered, twice

U64 = np.uint64
OUT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

#: A perfect difference set; every residue of PERIOD is a difference of two of them.
PERIOD = 273
COVER = (0, 1, 3, 7, 15, 31, 63, 90, 116, 127, 136, 181, 194, 204, 233, 238, 255)

_PATTERN = np.zeros(PERIOD, dtype=bool)
_PATTERN[list(COVER)] = True


class _Suffixes:
    """Byte fingerprints of a chunk, and the places of its cover sample with those of their first bytes (``prints``)."""

    def __init__(self, chunk: X.Chunk, length: int):
        self.chunk, self.length = chunk, length
        self.depth = length - PERIOD + 1
        self.sums = H.byte_sums(chunk.data)
        sampled = np.zeros(len(chunk.data), dtype=bool)
        for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            if b - a >= length:
                sampled[a : b - self.depth + 1] = np.resize(_PATTERN, b - a - self.depth + 1)
        self.at = np.flatnonzero(sampled)
        self.prints = H.byte_window_hashes(self.sums, self.at, self.depth)
        texts = chunk.data.tobytes()
        digest = [hashlib.blake2b(texts[a:b], digest_size=16).digest() for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)]
        self.digests = np.frombuffer(b"".join(digest), dtype="<u8").reshape(-1, 2).astype(U64)

    def full(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the suffixes' first ``length`` bytes, and 16 bits of independent ones."""
        more = H.byte_window_hashes(H.byte_sums(self.chunk.data, H.SECOND), at, self.length)
        return H.byte_window_hashes(self.sums, at, self.length), (more >> U64(48)).astype("<u2")

    def copies(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Which documents equal another one; which of these are not the first of their kind."""
        out = np.ones(len(self.digests), dtype=bool)
        first_here = np.zeros(len(self.digests), dtype=bool)
        for k in (0, 1):
            distinct, first, back, count = np.unique(self.digests[:, k], return_index=True, return_inverse=True, return_counts=True)
            state = X.read_flags(replies, 1, 1 + k, as_bits=False)
            later = np.ones(len(back), dtype=bool)
            later[first] = False
            first_here |= ~later & (state[back] != 2)
            out &= (state[back] > 0) | (count > 1)[back]
        return out, out & ~first_here

    def long_ties(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Places of suffixes with a tied sample in their first period, and copied documents."""
        chunk, (copies, later) = self.chunk, self.copies(replies)
        distinct, back, here = twice(self.prints)
        tied = self.at[((X.read_flags(replies, 1, 0, as_bits=False) > 0) | here)[back]] if len(distinct) else self.at
        open_ = covered(len(chunk.data), np.maximum(tied - (PERIOD - 1), 0), PERIOD)
        whole = np.zeros(len(chunk.data), dtype=bool)
        for a, b, copy in zip(chunk.starts.tolist(), chunk.ends.tolist(), later.tolist(), strict=True):
            if not copy and b - a >= self.length:
                whole[a : b - self.length + 1] = True
        return np.flatnonzero(open_ & whole), copies


def _first_of_equals(lists: list[tuple], part: int) -> list[np.ndarray]:
    """0: no other list has the key; 1: others have it, this is the first; 2: an earlier list has it."""
    if part == 0:
        return [x.astype(np.uint8) for x in X.repeated(lists)]
    lists = [x for x, _ in lists]
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    sorted_ = every[order]
    same = np.concatenate(([False], sorted_[1:] == sorted_[:-1]))
    state = np.where(same, 2, np.where(np.concatenate((same[1:], [False])), 1, 0)).astype(np.uint8)
    out = np.empty(len(every), dtype=np.uint8)
    out[order] = state
    return np.split(out, np.cumsum([len(x) for x in lists])[:-1])


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, chunk_bytes: int | None = None, bucket_items: int | None = None) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, digest and bytes that are kept.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else, in the same document or another. ``length`` is at least PERIOD + 8. A null
    text is empty; a null id stays null; rows that share an id are separate documents;
    texts shorter than ``length`` stay whole; ids are cast to long; other columns are ignored.
    """
    if length < PERIOD + 8:
        raise ValueError(f"length must be at least {PERIOD + 8}")
    size = X.corpus_bytes(docs, text)
    chunk_bytes, bucket_items = chunk_bytes or X.chunk_size(size * len(COVER) / PERIOD, PERIOD / len(COVER)), bucket_items or X.bucket_size(size * len(COVER) / PERIOD)
    sample_bits = X.bits_for(size * len(COVER) / PERIOD, bucket_items)
    bits = X.bits_for(size / 4, bucket_items)
    chunks = X.chunked(docs, doc_id, text, chunk_bytes)

    def sample(chunk):
        s = _Suffixes(chunk, length)
        return [X.requests(chunk.chunk_id, np.unique(s.prints), sample_bits), *(X.requests(chunk.chunk_id, np.unique(s.digests[:, k]), sample_bits, part=1 + k) for k in (0, 1))]

    def suffixes(chunk, replies):
        s = _Suffixes(chunk, length)
        at, _ = s.long_ties(replies)
        keys, more, *_ = X.distinct_pairs(*s.full(at))
        return [X.requests(chunk.chunk_id, keys, bits, more=more)]

    def finish(chunk, replies):
        s = _Suffixes(chunk, length)
        at, copies = s.long_ties(replies)
        distinct, _, back, here = X.distinct_pairs(*s.full(at))
        again = at[(X.read_flags(replies, 2) | here)[back]] if len(distinct) else at
        gone = covered(len(chunk.data), again, length)
        raw, rows = chunk.data, []
        for a, b, copy in zip(chunk.starts.tolist(), chunk.ends.tolist(), copies.tolist(), strict=True):
            cut = gone[a:b]
            if copy and b - a >= length:
                cut = np.ones(b - a, dtype=bool)
            kept = raw[a:b][~cut].tobytes()
            runs = int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(len(cut) > 0 and cut[0])
            rows.append((b - a, b - a - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
        n, removed, spans, digests, kept = zip(*rows, strict=True)
        return [pa.RecordBatch.from_pydict({"doc_id": chunk.id_column(), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": list(digests), "kept": pa.array(kept, pa.binary())})]

    first = X.answer(X.send(chunks, sample), 1, _first_of_equals, as_bits=False).repartition(X.partitions(docs.sparkSession), "chunk_id")
    second = X.answer(X.with_replies(chunks, first, suffixes, X.REQUEST_SCHEMA), 2)
    return X.with_replies(chunks, first.unionByName(second), finish, OUT_SCHEMA)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLES: dict[str, str] = {}
