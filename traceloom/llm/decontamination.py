"""Benchmark decontamination (operator 1): rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of the benchmark items are counted over all documents. An alignment of the
wanted score leaves a number of an item's n-grams whole, wherever the edits are. All
n-grams but a few of the commonest, fewer than that number, are the item's seeds, so any
such copy holds some. Where enough seeds stand close together in a document, the words
around them are aligned with the items that have these seeds, and the local alignment's
score says how much of an item is there, edited or not.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.llm.hashing import U64, letter_words, mix, windows
from traceloom.llm.scratch import Scratch

FILTER_BITS = 24
#: Numbers of seeds that the filter of seeds tells apart; more count as the last.
LEVELS = 3
ITEMS = "item_id long, words binary, n_words int, size int, whole int, grams array<long>"
REGIONS = "region string, doc_id long, doc_key long, first int, words binary, grams array<long>, places array<int>"
ALIGNED = "doc_id long, doc_key long, item_id long, score double, first_word int, last_word int"


def _grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that lie within one text, and the place of the first word of each."""
    every = windows(words, n)
    if not len(every):
        return every, np.empty(0, np.int64)
    at = np.flatnonzero(first[: len(every)] == first[n - 1 : n - 1 + len(every)])
    return every[at], at


def _grams_of(words: np.ndarray, first: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of several lengths, by place."""
    parts = [_grams(words, first, n) for n in sizes]
    if len(parts) == 1:
        return parts[0]
    grams, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(at, kind="stable")
    return grams[order], at[order]


def seeding(length: int, n: int, least_score: float) -> tuple[int, int]:
    """The n-gram length for an item of ``length`` words, and how many of its n-grams any copy leaves whole.

    A copy of the least score has m equal words and p unequal ones and gaps, m - p >= k. The
    equal ones stand in at most p + 1 runs, so m - (n - 1)(p + 1) n-grams or more are whole.
    The greatest length up to ``n`` that leaves one is taken. An item of ``n`` words or fewer
    is found as it stands only: its one n-gram is the whole. (0, 0): no words.
    """
    if length <= n:
        return (length, 1) if length else (0, 0)
    k = max(1, math.ceil(least_score * length - 1e-9))
    for size in range(n, 0, -1):
        whole = k if size == 1 else k - (size - 1) - (length - k) * (size - 2)
        if whole >= 1:
            return size, whole
    return 0, 0


def _bits(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) >> U64(64 - FILTER_BITS)).astype(np.int64)


def _bit_filters(grams: DataFrame, level: Column, levels: int) -> list[np.ndarray]:
    """For each level from 1 a bit for each hash prefix that occurs with it or a lower one, packed: 2 MB each, whatever the number of n-grams.

    The bits are or-ed in the tasks that make them and then by word, so only the filters come to the driver.
    """

    def run(batches):
        for batch in batches:
            slots, level_ = _bits(batch.column(0).to_numpy().astype(np.int64).view(U64)), batch.column(1).to_numpy()
            key = np.unique((level_.astype(np.int64) << FILTER_BITS) | slots)
            words, first = np.unique(key >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(U64(1) << (key & 63).astype(U64), first) if len(key) else np.empty(0, U64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.int64()), "bits": pa.array(bits.view(np.int64), pa.int64())})

    found = grams.select("gram", level.cast("long")).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    every = np.zeros((levels + 1, 1 << (FILTER_BITS - 6)), dtype="<u8")
    every.reshape(-1)[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(U64)
    # A slot is one bit, counted from the lowest of its word; packed bytes count from the highest.
    as_bytes = [np.packbits(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in np.bitwise_or.accumulate(every, axis=0)[1:]]
    return as_bytes


def _bit_filter(grams: DataFrame) -> np.ndarray:
    return _bit_filters(grams, F.lit(1), 1)[0]


def _level_filter(seeds: DataFrame) -> np.ndarray:
    """For each hash prefix of a seed the least number of seeds that an item with it asks for, up to ``LEVELS``; 0 where there is none. Two packed planes of bits."""
    levels = np.zeros(1 << FILTER_BITS, dtype=np.uint8)
    upto = _bit_filters(seeds, F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.col("asked"))), LEVELS)
    for level in range(LEVELS, 0, -1):
        levels[np.unpackbits(upto[level - 1]).astype(bool)] = level
    return np.stack([np.packbits(levels & 1), np.packbits(levels >> 1)])


def items_of(benchmark: DataFrame, item_id: str, text: str, n: int, least_score: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.large_binary())]
            words, _, count, *_ = letter_words(texts)
            size, whole = zip(*(seeding(c, n, least_score) for c in count.tolist()), strict=True) if len(texts) else ((), ())
            mine = [words[e - c : e] for c, e in zip(count, np.cumsum(count), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "item_id": batch.column(0), "words": pa.array([w.tobytes() for w in mine], pa.binary()), "n_words": pa.array(count, pa.int32()), "size": pa.array(size, pa.int32()), "whole": pa.array(whole, pa.int32()),
                "grams": pa.array([windows(w, k).view(np.int64) if k else [] for w, k in zip(mine, size, strict=True)], pa.list_(pa.int64())),
            })

    return benchmark.select(F.col(item_id).cast("long"), F.col(text)).mapInArrow(run, ITEMS)


def _document_counts(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """Documents of each n-gram that passes the filter, counted by batch before any shuffle."""

    def run(batches):
        known = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(0).cast(pa.large_binary())]
            words, owner, *_ = letter_words(texts)
            grams, at = _grams_of(words, owner, sizes)
            hit = known[_bits(grams)]
            pairs = np.unique(np.stack([grams[hit], owner[at[hit]].astype(U64)]), axis=1) if hit.any() else np.empty((2, 0), U64)
            distinct, count = np.unique(pairs[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(distinct.view(np.int64)), "docs": pa.array(count.astype(np.int64))})

    return docs.mapInArrow(run, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))


def _seed_regions(docs: DataFrame, levels, sizes: list[int], reach: int) -> DataFrame:
    """Stretches of documents in which possible seeds follow each other within ``reach`` words, as many as an item asks for.

    A stretch that is longer than 8 * reach is cut into overlapping ones, so that no row grows with a document.
    """

    def run(batches):
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        low_bit, high_bit = (np.unpackbits(x) for x in levels.value)
        asks = low_bit + 2 * high_bit
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.large_binary())]
            words, owner, count, *_ = letter_words(texts)
            grams, at = _grams_of(words, owner, sizes)
            level = asks[_bits(grams)]
            hit = np.flatnonzero(level)
            ends = np.cumsum(count)
            out: list[tuple] = []
            if len(hit):
                place, gram, text, asked = at[hit], grams[hit], owner[at[hit]], level[hit]
                cut = np.flatnonzero((np.diff(place) > reach) | (np.diff(text) > 0)) + 1
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(hit)], strict=True):
                    while a < b:
                        stop = min(b, int(np.searchsorted(place, place[a] + 8 * reach, side="right")))
                        begin, end = int(ends[text[a]] - count[text[a]]), int(ends[text[a]])
                        low, high = max(begin, int(place[a]) - reach), min(end, int(place[stop - 1]) + max(sizes) + reach)
                        doc = int(text[a])
                        # Some k seeds here ask for k or fewer.
                        if (np.sort(asked[a:stop])[:LEVELS] <= np.arange(1, LEVELS + 1)[: stop - a]).any():
                            out.append((f"{task}-{serial}", batch.column(0)[doc].as_py(), batch.column(1)[doc].as_py(), low - begin, words[low:high].tobytes(), gram[a:stop].view(np.int64), (place[a:stop] - low).astype(np.int32)))
                            serial += 1
                        if stop == b:
                            break
                        a = max(a + 1, int(np.searchsorted(place, place[stop - 1] - 2 * reach)))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({name: pa.array(c, t) for name, c, t in zip(("region", "doc_id", "doc_key", "first", "words", "grams", "places"), cols, types, strict=True)})

    return docs.mapInArrow(run, REGIONS)


def align(item: np.ndarray, words: np.ndarray, gap: int = 1) -> tuple[float, int, int]:
    """Smith-Waterman: the best score (equal words 1, unequal and gaps -1) as a share of the item, and where it begins and ends in ``words``."""
    n = len(words)
    columns = np.arange(n + 1)
    last, begun = np.zeros(n + 1, dtype=np.int64), columns.copy()
    best = (0, 0, 0)
    for word in item:
        step = np.where(words == word, 1, -1)
        across = last[:-1] + step
        score, start = np.zeros(n + 1, dtype=np.int64), columns.copy()
        score[1:], start[1:] = across, begun[:-1]
        down = last - gap
        better = down > score
        score, start = np.where(better, down, score), np.where(better, begun, start)
        fresh = score <= 0
        score, start = np.where(fresh, 0, score), np.where(fresh, columns, start)
        # A gap in the item: the best cell to the left, less one for each column between.
        lifted = score + gap * columns
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, columns, 0))
        along = top - gap * columns
        better = along > score
        score, start = np.where(better, along, score), np.where(better, start[source], start)
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k)
        last, begun = score, start
    return best[0] / max(1, len(item)), best[1], best[2]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = 3, least_seeds: int = 2, least_score: float = 0.6, scratch: Scratch | None = None, keys: bool = False,
) -> DataFrame:
    """One row for each document and item of which the document holds a copy: doc_id, item_id, score, first_word, last_word.

    A score of 0.6 stands for about four fifths of the item's words in order, as an unequal
    word costs as much as an equal one earns. Every copy with ``least_score`` is found; where
    it must hold so many, ``least_seeds`` seeds or more are asked for before an alignment.
    Null and empty texts hold nothing; items of ``n`` words or fewer are found only where all
    their words stand in order; items without words or with a null id are left out. Ids are
    cast to long. A repeated doc_id gets one row with the best score (with ``keys``, one for
    each ``doc_key``, the hash of the whole text).
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    # A repeated item_id with another text is another item.
    items = items_of(benchmark.where(F.col(item_id).isNotNull()), item_id, item_text, n, least_score).withColumn("item_key", F.xxhash64("item_id", "words"))
    items = scratch.save(items.dropDuplicates(["item_id", "words"]).withColumn("asked", F.least("whole", F.greatest(F.lit(least_seeds), F.floor(F.col("whole") / 2)))), "items")
    # Items of like length are looked for together, so that a long one doesn't make stretches long for all.
    step = F.floor(F.log(F.greatest(F.col("n_words"), F.lit(64)) / 64.0) / math.log(4) + 1e-9).cast("int").alias("step")
    steps = items.where("size > 0").groupBy(step).agg(F.max("n_words").alias("longest"), F.collect_set("size").alias("sizes")).orderBy("step").collect()  # a row for each fourfold length
    grams = items.select("item_key", "whole", "asked", step, F.explode("grams").alias("gram")).groupBy("item_key", "whole", "asked", "step", "gram").agg(F.count(F.lit(1)).alias("times"))
    bits = spark.sparkContext.broadcast(_bit_filter(grams.select("gram")))
    counts = _document_counts(docs.select(text), bits, sorted({x for r in steps for x in r.sizes}) or [n])
    by_commonness = W.partitionBy("item_key").orderBy(F.desc(F.coalesce("docs", F.lit(0))), "gram").rowsBetween(W.unboundedPreceding, 0)
    ranked = grams.join(counts, "gram", "left").withColumn("commonest", F.sum("times").over(by_commonness))
    seeds = scratch.save(ranked.where(F.col("commonest") > F.col("whole") - F.col("asked")).select("item_key", "gram", "times", "asked", "step"), "seeds")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"), F.col(text).alias("text"))
    short = items.select("item_key", "item_id", F.col("words").alias("item"))
    few = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    task = None
    for r in steps:
        mine = seeds.where(F.col("step") == r.step)
        levels = spark.sparkContext.broadcast(_level_filter(mine))
        # An alignment has at most n_words equal words, and (1 - least_score) * n_words unequal ones and gaps.
        reach = max(n, math.ceil((2 - least_score) * r.longest))
        regions = scratch.save(_seed_regions(rows, levels, sorted(r.sizes), reach), f"regions-{r.step}")
        hits = regions.select("region", F.explode(F.array_distinct("grams")).alias("gram"))
        pairs = hits.join(mine, "gram").groupBy("region", "item_key", "asked").agg(F.sum("times").alias("held")).where(F.col("held") >= F.col("asked")).select("region", "item_key")
        part = pairs.join(regions.select("region", "doc_id", "doc_key", "first", "words"), "region").join(F.broadcast(short) if few <= 16 << 20 else short, "item_key")
        part = part.select("item_id", "item", "doc_id", "doc_key", "first", "words")
        task = part if task is None else task.unionByName(part)
    by = ["doc_id", "item_id", *(["doc_key"] if keys else [])]
    if task is None:
        return spark.createDataFrame([], ALIGNED).select(*by, "score", "first_word", "last_word")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                score, a, b = align(np.frombuffer(r["item"], dtype=U64), np.frombuffer(r["words"], dtype=U64))
                if score >= least_score:
                    out.append((r["doc_id"], r["doc_key"], r["item_id"], score, r["first"] + a, r["first"] + b))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_pydict({name: pa.array(c, t) for name, c, t in zip(("doc_id", "doc_key", "item_id", "score", "first_word", "last_word"), cols, types, strict=True)})

    found = task.mapInArrow(run, ALIGNED)
    best = found.groupBy(*by).agg(F.max(F.struct("score", "first_word", "last_word")).alias("b"))
    return best.select(*by, "b.score", "b.first_word", "b.last_word")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark)


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES: dict[str, str] = {}
