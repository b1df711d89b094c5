"""Removal of repeated word windows (operator 8): count-min prefilter, then exact groups.

Every partition's sketch of window counts is merged by adding counters. A merged
counter is never below the true count, so a window that occurs twice always reads
two or more; only such windows are grouped exactly in the second pass. A sketch
grows with the corpus, so it is cut into slices: a chunk sends the counters that it
touched of each slice, the slice's task adds them up and returns one bit for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from traceloom.llm import exchange as X
from traceloom.llm import hashing as H

U64 = np.uint64
OUT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


class _Words:
    """Words of a chunk, and the fingerprint of each window that lies in one document; with ``both`` a second one."""

    def __init__(self, chunk: X.Chunk, window: int, both: bool = False):
        self.starts, self.ends = H.word_bounds(separated(chunk))
        shift = np.searchsorted(chunk.starts + np.arange(len(chunk.starts)), self.starts, side="right") - 1
        self.first = np.searchsorted(shift, np.arange(len(chunk.ids) + 1))
        data = separated(chunk)
        words = H.span_hashes(data, self.starts, self.ends) if len(self.starts) else np.empty(0, U64)
        every = H.windows(words, window)
        doc_end = self.first[1:][shift] if len(shift) else np.empty(0, np.int64)
        inside = np.arange(len(every)) + window <= doc_end[: len(every)]
        self.at = np.flatnonzero(inside)
        self.keys = every[self.at]
        self.data = data
        if both:  # 32 bits of an independent fingerprint
            self.more = (H.windows(H.span_hashes(data, self.starts, self.ends, H.SECOND), window)[self.at] >> U64(32)).astype("<u4")


def separated(chunk: X.Chunk) -> np.ndarray:
    """The texts with one space after each, so that words never cross documents."""
    n = len(chunk.ids)
    out = np.full(len(chunk.data) + n, 0x20, dtype=np.uint8)
    where = np.arange(len(chunk.data)) + np.repeat(np.arange(n), chunk.ends - chunk.starts)
    out[where] = chunk.data
    return out


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return H.mix(keys + U64(0x632BE59BD9B4E019) * U64(row + 1)) >> U64(64 - bits)


def twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each key among them, which of them occur twice or more here."""
    distinct, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, back, count > 1


def _merge_counters(lists: list[tuple], part: int) -> list[np.ndarray]:
    """Adds the partial sketches of one slice, and reads whether each touched counter is above one."""
    lists = [x for x, _ in lists]
    high = int(max(x[-1] for x in lists)) + 1
    counters = np.zeros(high, dtype=np.uint8)
    for x in lists:
        counters[x] = np.minimum(counters[x] + 1, 2)
    return [counters[x] > 1 for x in lists]


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in a window of that width from one of the starts."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeated_windows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, depth: int = 2,
    counters_per_window: int = 4, chunk_bytes: int | None = None, bucket_items: int | None = None,
) -> DataFrame:
    """Per document: words, words removed, digest and text of the words kept.

    A word goes if a window of ``window`` words that covers it starts anywhere else
    too. Null and empty texts have no words and keep the empty text; a null id stays
    null; rows that share an id are separate documents; ids are cast to long; other columns are ignored.
    ``counters_per_window`` and ``depth`` only set how many windows that occur once
    reach the second pass; the result does not depend on them.
    """
    size = X.corpus_bytes(docs, text)
    items = max(1, size // 6)
    chunk_bytes, bucket_items = chunk_bytes or X.chunk_size(items, 6), bucket_items or X.bucket_size(items)
    bits = max(16, (items * counters_per_window - 1).bit_length())
    slices = X.bits_for(items, bucket_items)
    chunks = X.chunked(docs, doc_id, text, chunk_bytes)

    def sketch(chunk):
        keys = _Words(chunk, window).keys
        return [X.requests(chunk.chunk_id, np.unique(_cells(keys, r, bits)), slices, bits, r) for r in range(depth)]

    def estimated(words: _Words, replies: pa.Table) -> np.ndarray:
        """Which windows the merged sketch counts twice or more."""
        often = np.ones(len(words.keys), dtype=bool)
        for r in range(depth):
            distinct, back, here = twice(_cells(words.keys, r, bits))
            often &= (X.read_flags(replies, 1, r) | here)[back] if len(distinct) else False
        return often

    def exact(chunk, replies):
        words = _Words(chunk, window, both=True)
        often = estimated(words, replies)
        keys, more, *_ = X.distinct_pairs(words.keys[often], words.more[often])
        return [X.requests(chunk.chunk_id, keys, slices, more=more)]

    def finish(chunk, replies):
        words = _Words(chunk, window, both=True)
        often = np.flatnonzero(estimated(words, replies))
        distinct, _, back, here = X.distinct_pairs(words.keys[often], words.more[often])
        again = (X.read_flags(replies, 2) | here)[back] if len(distinct) else np.empty(0, bool)
        gone = covered(len(words.starts), words.at[often[again]], window)
        n_words, n_gone, digests, texts = [], [], [], []
        raw = words.data.tobytes()
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            keep = np.flatnonzero(~gone[a:b]) + a
            kept = b" ".join([raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)])
            n_words.append(b - a)
            n_gone.append(b - a - len(keep))
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8", "replace"))
        return [pa.RecordBatch.from_pydict({"doc_id": chunk.id_column(), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": digests, "kept_text": texts})]

    first = X.answer(X.send(chunks, sketch), 1, _merge_counters).repartition(X.partitions(docs.sparkSession), "chunk_id")
    second = X.answer(X.with_replies(chunks, first, exact, X.REQUEST_SCHEMA), 2)
    return X.with_replies(chunks, first.unionByName(second), finish, OUT_SCHEMA)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT s FROM k GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM k SEMI JOIN again USING (s)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (r, j) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""

QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {"op8_substring_dedup": _ORACLE}
