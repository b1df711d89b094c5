"""Best-two-fit packing of tokenised documents into sequences (operator 7).

Packing depends on lengths only, and there are no more lengths than a sequence has
tokens. So the pieces are counted by length; a plan of bin patterns, each with a
number of times, is made from that bounded histogram; and each piece finds its place
from its rank among the pieces of its length. No piece passes through the driver.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.llm.hashing import LOW_BYTES, U64, lower_ascii, span_hashes, word_bounds
from traceloom.llm.scratch import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TOKENIZERS: dict[str, WordTokenizer] = {}


#: Letters that no normal form changes or joins.
_LATIN = re.compile(r"[a-zA-Z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_TAIL = np.zeros(256, dtype=bool)
_TAIL[list(b".,!?;:%$#&*|")] = True
_ALNUM = np.array([chr(c).isalnum() for c in range(128)] + [False] * 128)


class WordTokenizer:
    """Token ids of many texts at once, for tokenizers that drop white space and lower-case.

    Such a tokenizer never joins what white space parts, nor letters and digits with the
    punctuation after them, so that a text's ids are those of its parts in order: of each
    word the stem, then the final punctuation. Parts repeat. A table holds the ids of up to
    ``most`` of them, by fingerprint, length, first and last eight bytes.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.keys, self.rows = np.empty(0, U64), np.empty(0, np.int64)
        # Row 0 is the part without bytes or ids.
        self.check, self.first, self.count, self.ids = np.zeros((1, 3), U64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each part has. Words of letters only are encoded together: each ends in an id of word ends."""
        texts = [p.decode() for p in parts]
        whole = np.array([t.isalpha() and t.isascii() or _LATIN.fullmatch(t) is not None for t in texts], dtype=bool)
        count = np.zeros(len(parts), dtype=np.int64)
        flat = []
        for which in (True, False):
            mine = np.flatnonzero(whole == which)
            for at in range(0, len(mine), 5000):
                some = mine[at : at + 5000]
                joined = [" ".join([texts[i] for i in some.tolist()])] if which else [texts[i] for i in some.tolist()]
                found = self._ids(joined)
                ids = np.array(list(chain.from_iterable(found)), dtype=np.uint32)
                if which:
                    ends = np.flatnonzero(self.is_end[ids]) + 1
                    if len(ends) != len(some):
                        raise ValueError("the tokenizer doesn't mark the ends of words")
                    count[some] = np.diff(ends, prepend=0)
                else:
                    count[some] = [len(x) for x in found]
                flat.append(ids)
        order = np.concatenate([np.flatnonzero(whole), np.flatnonzero(~whole)])
        ids = np.concatenate(flat) if flat else np.empty(0, np.uint32)
        first = np.empty(len(parts), dtype=np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return ids[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(ids))], count

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, check: np.ndarray) -> None:
        raw = data.tobytes()
        flat, count = self._encoded([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        rows = np.arange(len(keys)) + len(self.count)
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count) - count))
        self.count, self.ids, self.check = np.concatenate((self.count, count)), np.concatenate((self.ids, flat)), np.concatenate((self.check, check))
        every = np.concatenate((self.keys, keys))
        order = np.argsort(every, kind="stable")
        self.keys, self.rows = every[order], np.concatenate((self.rows, rows))[order]

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table row of each part; new ones are learned."""
        keys = span_hashes(data, starts, ends)
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)

        def place():
            k = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
            return k, (self.keys[k] == distinct) if len(self.keys) else np.zeros(len(distinct), bool)

        # Length, first and last eight bytes of each part.
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        size = ends - starts
        check = np.stack([size.astype(U64), eight[starts] & LOW_BYTES[np.minimum(size, 8)], eight[np.maximum(starts, ends - 8)] & LOW_BYTES[np.minimum(size, 8)]], axis=1)
        _, known = place()
        if len(self.count) + np.count_nonzero(~known) > self.most:
            self._forget()
            known = np.zeros(len(distinct), bool)
        new = at[~known]
        if len(new):
            self._learn(data, distinct[~known], starts[new], ends[new], check[new])
        rows = self.rows[place()[0]][back]
        wrong = np.flatnonzero((self.check[rows] != check).any(axis=1))
        if len(wrong):  # another part with the same fingerprint
            raw = data.tobytes()
            flat, count = self._encoded([raw[starts[i] : ends[i]] for i in wrong.tolist()])
            rows[wrong] = np.arange(len(wrong)) + len(self.count)
            self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count) - count))
            self.count, self.ids, self.check = np.concatenate((self.count, count)), np.concatenate((self.ids, flat)), np.concatenate((self.check, check[wrong]))
        return rows

    def _parts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, special: np.ndarray) -> np.ndarray:
        """Where each word's final punctuation begins: its end where a split might change the ids."""
        cut = ends.copy()
        live = np.arange(len(cut))
        for _ in range(16):
            live = live[_TAIL[raw[cut[live] - 1]]]
            if not len(live):
                break
            cut[live] -= 1
            live = live[cut[live] > starts[live]]
        for i in live.tolist():
            cut[i] = starts[i] + len(raw[starts[i] : ends[i]].tobytes().rstrip(b".,!?;:%$#&*|"))
        last = raw[cut - 1]
        # A letter or digit of ASCII, or one of the two-byte letters up to U+00FF.
        good = (cut > starts) & (_ALNUM[last] | ((last >= 0x80) & (raw[np.maximum(cut - 2, 0)] == 0xC3) & (last != 0x97) & (last != 0xB7) & (cut - 2 >= starts)))
        good[np.searchsorted(starts, np.concatenate((special, np.flatnonzero(raw == 0x27))), side="right") - 1] = False
        return np.where(good, cut, ends)

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by ``end_id``, and where each text's ids end."""
        raw = np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)
        starts, ends = word_bounds(raw)
        data = lower_ascii(raw)
        special = np.flatnonzero(_pairs(raw, b"<|"))
        for k in np.unique(np.searchsorted(starts, special, side="right") - 1).tolist():  # special tokens are told by case
            data[starts[k] : ends[k]] = raw[starts[k] : ends[k]]
        rows = np.zeros((len(starts), 2), dtype=np.int64)
        if len(starts):
            cut = self._parts(raw, starts, ends, special)
            tailed = np.flatnonzero(cut < ends)
            every = self._look_up(data, np.concatenate((starts, cut[tailed])), np.concatenate((cut, ends[tailed])))
            rows[:, 0], rows[tailed, 1] = every[: len(starts)], every[len(starts) :]
        flat_rows = rows.reshape(-1)
        size, first = self.count[flat_rows], self.first[flat_rows]
        stops = np.cumsum(size)
        words_before = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]) - 1)
        text_ends = np.concatenate(([0], stops))[2 * words_before]
        ids = self.ids[np.repeat(first - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)] if len(stops) else np.empty(0, np.uint32)
        if end_id is not None:
            ids = np.insert(ids, text_ends, np.uint32(end_id))
            text_ends = text_ends + np.arange(1, len(texts) + 1)
        return ids, text_ends


def _pairs(raw: np.ndarray, pair: bytes) -> np.ndarray:
    """The places of two given bytes in a row."""
    out = np.zeros(len(raw), dtype=bool)
    out[:-1] = (raw[:-1] == pair[0]) & (raw[1:] == pair[1])
    return out


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _parcels(batches, size: int = 4 << 20):
    """Ids and texts in lists of about ``size`` bytes, so that memory doesn't follow the batch."""
    docs, texts, held = [], [], 0
    for batch in batches:
        for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            docs.append(doc)
            texts.append(content.as_py() or b"")
            held += len(texts[-1])
            if held >= size:
                yield docs, texts
                docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


def tokenized_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", most: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``most`` tokens; ``ids`` (little-endian 32-bit) only where asked for.

    Every document ends in ``end_id``, so an empty or null text is a piece of one token.
    A null id stays null; ids are cast to long; rows that share an id are separate documents.
    """

    def run(batches):
        mine = tokenizer(path)
        for docs_, texts in _parcels(batches):
            flat, ends = mine.encode(texts, end_id)
            flat = flat.astype("<u4")
            rows: list[tuple] = []
            for doc, low, high in zip(docs_, [0, *ends.tolist()], ends.tolist(), strict=False):
                for k, at in enumerate(range(low, high, most)):
                    piece = flat[at : min(at + most, high)]
                    rows.append((doc, k, at - low, len(piece), zlib.crc32(piece), piece.tobytes() if with_ids else None))
            doc, k, start, length, crc, ids = zip(*rows, strict=True) if rows else ((),) * 6
            out = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def plan_bins(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns and how often each is used, for ``counts[l]`` pieces of each length l.

    A bin takes the longest piece left, then again and again the longest that fits. Then
    its shortest piece is replaced by two pieces left that fill the gap, widened by that
    piece, more tightly, if there are such. A pattern is used until one of its lengths
    has too few pieces left, so that the patterns number no more than a few for each length.
    """
    left = counts.astype(np.int64).copy()
    index = np.arange(most + 1)
    plan = []
    while True:
        have = np.flatnonzero(left[1:]) + 1
        if not len(have):
            return plan
        used: dict[int, int] = {}

        def take(length: int) -> None:
            left[length] -= 1
            used[length] = used.get(length, 0) + 1  # noqa: B023

        take(int(have[-1]))
        gap = most - int(have[-1])
        while gap:
            fit = np.flatnonzero(left[1 : gap + 1])
            if not len(fit):
                break
            take(int(fit[-1]) + 1)
            gap -= int(fit[-1]) + 1
        if gap and sum(used.values()) > 1:
            shortest = min(used)
            wide = gap + shortest
            longest_to = np.maximum.accumulate(np.where(left > 0, index, 0))
            first = np.flatnonzero(left[1 : wide + 1]) + 1
            second = longest_to[wide - first]
            alone = (second == first) & (left[first] < 2)
            second = np.where(alone, longest_to[np.maximum(second - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > shortest:
                k = int(np.argmax(total))
                left[shortest] += 1
                used[shortest] -= 1
                if not used[shortest]:
                    del used[shortest]
                take(int(first[k]))
                take(int(second[k]))
        times = 1 + min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * (times - 1)
        plan.append((tuple(sorted((x for x, n in used.items() for _ in range(n)), reverse=True)), times))


def _slots(plan: list[tuple[tuple[int, ...], int]], most: int) -> dict[str, np.ndarray]:
    """For each length, by rank: the first sequence and the offset of a run of places."""
    rank = np.zeros(most + 1, dtype=np.int64)
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            rows.append((length, rank[length], sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, most: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, which have doc_id, piece, length and any other columns.

    ``pieces`` is read three times, so save it before. Only the histogram of at most
    ``most`` lengths comes to the driver, and the plan made from it goes to the tasks. A
    length of more than a thousandth of all pieces is ranked in several groups. Pieces
    that agree in doc_id, piece and length may swap places.
    """
    counts = np.zeros(most + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # one row for each length up to `most`
        counts[length] = n
    slots = _slots(plan_bins(counts, most), most)
    groups = np.maximum(1, -(-counts // max(1, int(counts.sum()) // 1000)))  # fewer than 1000 more than lengths
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.get(F.array(*map(F.lit, groups.tolist())), F.col("length").cast("int"))).cast("int"))
    before = dealt.groupBy("length", "_g").count().select("length", "_g", (F.sum("count").over(W.partitionBy("length").orderBy("_g")) - F.col("count")).alias("_before"))
    ranked = dealt.join(before, ["length", "_g"]).withColumn("_rank", F.col("_before") + F.row_number().over(W.partitionBy("length", "_g").orderBy("doc_id", "piece")) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        k = np.searchsorted(slots["key"], (length.to_numpy() << 48) | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": slots["sequence"][k] + rank.to_numpy() - slots["rank"][k], "offset": slots["offset"][k]})

    return ranked.withColumn("_p", place("length", "_rank")).select(*pieces.columns, "_p.sequence_id", "_p.offset")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return pack(Scratch(spark).save(pieces, "pieces"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
