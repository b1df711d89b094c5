"""Toxicity by a chain of linear classifiers (operator 9).

Categories are predicted in a fixed order. Each has a logistic model over hashed words
that also gets the probabilities of the categories before it. A later model learns with
out-of-fold probabilities of the earlier ones, so that it meets in training what it
will meet on new documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.hashing import U64, letter_words

BITS = 18


def word_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text and bucket of each distinct word of each text, in order of the texts."""
    words, owner, *_ = letter_words(texts)
    both = np.unique((owner.astype(U64) << U64(BITS)) | (words >> U64(64 - BITS)))
    return (both >> U64(BITS)).astype(np.int64), (both & U64((1 << BITS) - 1)).astype(np.int64)


class LinearModel:
    """Logistic regression on chosen word buckets and a few dense columns."""

    def __init__(self, features: int = 4096, deviations: float = 3.0, ridge: float = 0.5, rounds: int = 200):
        self.features, self.deviations, self.ridge, self.rounds = features, deviations, ridge, rounds

    def fit(self, owner: np.ndarray, bucket: np.ndarray, dense: np.ndarray, label: np.ndarray) -> LinearModel:
        n, positive = len(label), label > 0.5
        seen, hit = np.bincount(bucket, minlength=1 << BITS), np.bincount(bucket[positive[owner]], minlength=1 << BITS)
        rate = positive.mean() if n else 0.0
        # Standard deviations by which a word's share of positives is off; chance alone seldom gives three.
        score = np.where(seen > 1, np.abs(hit - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 0.25), 0.0)
        chosen = np.argsort(-score, kind="stable")[: self.features]
        chosen = chosen[score[chosen] >= self.deviations]
        column = np.full(1 << BITS, -1)
        column[chosen] = np.arange(len(chosen))
        keep = column[bucket] >= 0
        row, col = owner[keep], column[bucket[keep]]
        w, v, b = np.zeros(len(chosen)), np.zeros(dense.shape[1]), np.log((positive.sum() + 0.5) / (n - positive.sum() + 0.5))
        squares = [np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6]
        for _ in range(self.rounds):
            logit = b + np.bincount(row, weights=w[col], minlength=n) + dense @ v
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label
            grads = [np.bincount(col, weights=error[row], minlength=len(w)) + self.ridge * w, dense.T @ error + self.ridge * v, error.sum()]
            squares = [s + g * g for s, g in zip(squares, grads, strict=True)]
            w, v, b = (x - 0.5 * g / np.sqrt(s) for x, g, s in zip((w, v, b), grads, squares, strict=True))
        self.weights = np.zeros(1 << BITS, dtype=np.float32)
        self.weights[chosen] = w
        self.dense, self.bias = v, float(b)
        return self

    def probability(self, owner: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
        logit = self.bias + np.bincount(owner, weights=self.weights[bucket], minlength=len(dense)) + dense @ self.dense
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_chain(owner: np.ndarray, bucket: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = 3) -> tuple[list[LinearModel], list[float]]:
    """A model and a threshold for each column of ``labels``; column k sees columns before it."""
    n, models, cuts, dense = len(labels), [], [], np.zeros((len(labels), 0))
    for k in range(labels.shape[1]):
        out = np.zeros(n)
        for f in range(folds):
            rows = fold != f
            place = np.cumsum(rows) - 1
            mine = rows[owner]
            model = LinearModel().fit(place[owner[mine]], bucket[mine], dense[rows], labels[rows, k])
            out[~rows] = model.probability(owner, bucket, dense)[~rows]
        models.append(LinearModel().fit(owner, bucket, dense, labels[:, k]))
        # The threshold with the best F1 of the out-of-fold probabilities, in the middle of its plateau.
        grid = np.linspace(0.05, 0.95, 19)
        true = labels[:, k] > 0.5
        f1 = np.array([2 * (true & (out >= c)).sum() / max(1, true.sum() + (out >= c).sum()) for c in grid])
        cuts.append(float(np.median(grid[f1 >= f1.max() - 1e-9])))
        dense = np.column_stack([dense, _logit(out)])
    return models, cuts


def learn_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], doc_id: str = "doc_id", text: str = "text", sample: int = 6000, folds: int = 3) -> tuple[list[LinearModel], list[float]]:
    """Fits the chain on at most ``sample`` labelled documents, chosen by a hash of their ids.

    ``categories`` gives for each name, in chain order, SQL for its 0/1 label over ``labels``.
    Labels that are null in any category or whose document is missing don't count; of
    repeated ones the largest does, of documents that share an id the one whose words come
    first by their buckets. Ids are cast to long. The sample bounds what comes to the driver, and the
    ids by which the documents are found are broadcast.
    """
    marks = labels.select(F.col(doc_id).cast("long").alias("_id"), *[F.expr(e).cast("double").alias(c) for c, e in categories.items()]).dropna()
    marks = marks.groupBy("_id").agg(*[F.max(c).alias(c) for c in categories])
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    found = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(marks), "_id")

    def features(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("_text").cast(pa.large_binary())]
            owner, bucket = word_buckets(texts)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            blobs = [bucket[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "words": pa.array(blobs, pa.binary())} | {c: batch.column(c) for c in categories})

    rows = found.mapInArrow(features, "_id long, words binary, " + ", ".join(f"`{c}` double" for c in categories))
    rows = rows.groupBy("_id", *categories).agg(F.min("words").alias("words"))
    rows = sorted(rows.collect(), key=lambda r: r["_id"])
    words = [np.frombuffer(r["words"], dtype="<u4").astype(np.int64) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(w) for w in words])
    bucket = np.concatenate(words) if words else np.empty(0, np.int64)
    targets = np.array([[r[c] for c in categories] for r in rows], dtype=float).reshape(len(rows), len(categories))
    fold = np.array([(r["_id"] * 0x9E3779B1 >> 7) % folds for r in rows], dtype=np.int64)
    return fit_chain(owner, bucket, targets, fold, folds)


def predict_chain(docs: DataFrame, models: list[LinearModel], cuts: list[float], names: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, ``p_<name>`` and ``<name>`` (whether it reaches the threshold) for each category.

    A null or empty text has no words and gets the chain's base rates; a null id stays null.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast([(m.weights, m.dense, m.bias) for m in models])

    def run(batches):
        chain = []
        for weights, dense, bias in held.value:
            model = LinearModel()
            model.weights, model.dense, model.bias = weights, dense, bias
            chain.append(model)
        useful = np.any([m.weights != 0 for m in chain], axis=0)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.large_binary())]
            words, owner, *_ = letter_words(texts)
            bucket = (words >> U64(64 - BITS)).astype(np.int64)
            keep = useful[bucket]
            both = np.unique((owner[keep] << BITS) | bucket[keep])
            owner, bucket = both >> BITS, both & ((1 << BITS) - 1)
            out, dense = {"doc_id": batch.column(0)}, np.zeros((len(texts), 0))
            for name, model, cut in zip(names, chain, cuts, strict=True):
                p = model.probability(owner, bucket, dense)
                out |= {f"p_{name}": pa.array(p), name: pa.array(p >= cut)}
                dense = np.column_stack([dense, _logit(p)])
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, " + ", ".join(f"`p_{c}` double, `{c}` boolean" for c in names)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema)


#: The label table has two marks; the chain takes poor quality first, as junk text looks unlike prose, toxic or not.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    models, cuts = learn_chain(docs, labels, CATEGORIES)
    return predict_chain(docs, models, cuts, list(CATEGORIES)).select("doc_id", "p_low_quality", "p_toxic", "toxic")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
