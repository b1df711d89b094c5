"""Language of a document as a mixture (operator 5).

A language is a distribution of letter trigrams. A document is a mixture of languages;
expectation-maximisation estimates the proportions. Languages are added one by one as
long as the gain in log-likelihood exceeds a penalty that grows with the logarithm of
the document's length. The language with the largest share is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
SLICE = 1 << 12
COUNTS = "lang string, slice int, part int, counts binary"
OUT = "doc_id long, lang_pred string, score double, mixture map<string,double>"


@cache
def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower case, or 0 if it is no letter."""
    out = np.zeros(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams; a run of other characters is one boundary. Empty without a letter."""
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = _letters()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        low = low.copy()
        low[high] = [p if chr(p).isalpha() else 0 for p in points[high].tolist()]
    if not low.any():
        return np.empty(0, np.uint32)
    keep = low != 0
    keep[1:] |= low[:-1] != 0
    seq = np.concatenate((np.zeros(1, np.uint32), low[keep].astype(np.uint32), np.zeros(1, np.uint32)))
    h = seq[:-2] * np.uint32(0x9E3779B1) ^ seq[1:-1] * np.uint32(0x85EBCA77) ^ seq[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS)


def _count(batches):
    """Counts of each language in this task, in slices. No more than 64 languages are held at once."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    held: dict[str, np.ndarray] = {}

    def out():
        rows = [(lang, k, counts[k * SLICE : (k + 1) * SLICE].tobytes()) for lang, counts in held.items() for k in range((1 << BITS) // SLICE)]
        held.clear()
        lang, k, blob = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "slice": pa.array(k, pa.int32()), "part": pa.array([task] * len(rows), pa.int32()), "counts": pa.array(blob, pa.binary())})

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in held:
                if len(held) == 64:
                    yield out()
                held[lang] = np.zeros(1 << BITS, dtype="<i8")
            held[lang] += np.bincount(trigrams(text.as_py()), minlength=1 << BITS)
    if held:
        yield out()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a group's counts, one batch at a time."""
    total, key = np.zeros(SLICE, dtype="<i8"), {}
    for batch in batches:
        for blob in batch.column("counts"):
            total += np.frombuffer(blob.as_py(), dtype="<i8")
        if batch.num_rows:
            key = {c: batch.column(c)[:1] for c in ("lang", "slice", "part")}
    yield pa.RecordBatch.from_pydict(key | {"counts": pa.array([total.tobytes()], pa.binary())})


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", most_languages: int = 512) -> tuple[list[str], np.ndarray]:
    """Language names, and log-probabilities of trigram buckets by language.

    Counts cover all rows given whose language is not null. The model has 65,536 numbers
    for each language; more than ``most_languages`` are an error, so its size is bounded.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.col(text))
    # Counts of 512 input tasks meet in a group, then those of the groups: no task gets a blob of every other.
    some = rows.mapInArrow(_count, COUNTS).withColumn("part", F.floor(F.col("part") / F.lit(512.0)).cast("int")).groupBy("lang", "slice", "part").applyInArrow(_merge, COUNTS)
    merged = some.groupBy("lang", "slice").applyInArrow(_merge, COUNTS)
    slices = (1 << BITS) // SLICE
    found = merged.limit(most_languages * slices + 1).collect()
    if len(found) > most_languages * slices:
        raise ValueError(f"more than {most_languages} languages")
    names = sorted({r.lang for r in found})
    counts = np.zeros((1 << BITS, len(names)))
    for r in found:
        counts[r.slice * SLICE : (r.slice + 1) * SLICE, names.index(r.lang)] = np.frombuffer(r.counts, dtype="<i8")
    names_, seen = [], counts.sum(axis=0)
    keep = [k for k, _ in enumerate(names) if seen[k] > 0]
    names_ = [names[k] for k in keep]
    counts = counts[:, keep] + 0.1
    return names_, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _proportions(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the shares of p's columns for n occurrences of its rows."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        mass = p @ share
        share = share * ((n / mass) @ p) / total
    return share, float(n @ np.log(p @ share))


def mixture(found: np.ndarray, logp: np.ndarray, penalty: float = 3.0, rounds: int = 15) -> tuple[list[int], np.ndarray]:
    """The languages of a document, and their shares."""
    if len(found) < 4096:
        at, n = np.unique(found, return_counts=True)
    else:
        count = np.bincount(found, minlength=1 << BITS)
        at = np.flatnonzero(count)
        n = count[at]
    n = n.astype(np.float64)
    rows = logp[at].astype(np.float64)
    alone = n @ rows
    order = np.argsort(-alone, kind="stable")
    chosen, share, best = [int(order[0])], np.ones(1), float(alone[order[0]])
    p = np.exp(rows - rows.max(axis=1, keepdims=True))
    shift = float(n @ rows.max(axis=1))
    cost = penalty * np.log(n.sum() + 1)
    while len(chosen) < logp.shape[1]:
        # The language that explains best what the present mixture explains least.
        mass = p[:, chosen] @ share
        gain = (n / mass) @ p
        gain[chosen] = -1
        new = int(np.argmax(gain))
        share_, value = _proportions(p[:, [*chosen, new]], n, rounds)
        if value + shift < best + cost:
            break
        chosen, share, best = [*chosen, new], share_, value + shift
    return chosen, share


def predict(docs: DataFrame, names: list[str], logp: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (the share of that language), mixture.

    ``und`` with score 0 and an empty mixture for a text that is null or has no letter, and
    for all if no language was learned. Nothing but the text is looked at; ids are cast to long.
    """
    model = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches):
        for batch in batches:
            langs, scores, mixtures = [], [], []
            for content in batch.column(1):
                found = trigrams(content.as_py())
                if not len(found) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    mixtures.append([])
                    continue
                chosen, share = mixture(found, model.value)
                k = int(np.argmax(share))
                langs.append(names[chosen[k]])
                scores.append(min(1.0, float(share[k])))
                mixtures.append([(names[c], float(s)) for c, s in zip(chosen, share, strict=True)])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "mixture": pa.array(mixtures, pa.map_(pa.string(), pa.float64()))})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, OUT)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, logp = learn(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs, names, logp)
    shares = F.reverse(F.array_sort(F.transform(F.map_entries("mixture"), lambda e: F.struct(F.round(e["value"], 4).alias("share"), e["key"].alias("lang")))))
    mixture = F.array_join(F.transform(shares, lambda e: F.concat(e["lang"], F.lit(":"), F.format_string("%.4f", e["share"]))), ",")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", mixture.alias("mixture"))


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
