"""Phrase collocations (operator 12): phrases counted in burst tries, scored by their weakest cut.

A task counts the phrases of one length in a trie whose first levels are word ids and
whose leaves are hash containers of the words that follow. A container that grows too
large bursts into one for each next word; when the trie holds as many phrases as a task
may, its largest subtrees leave it whole, as sorted runs cut by a prefix of the
phrase. The runs of a prefix partition are merged in one task, so that a phrase meets
itself there once from each spill, however often it occurs.

Lengths are counted one after the other. A phrase is looked at only if both phrases
that are one word shorter may be frequent, as a bit filter of fixed size tells; the
filter lets some others pass but loses none, and every count is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from traceloom.llm.exchange import bits_for, bucket_size, corpus_bytes, expand, squeeze
from traceloom.llm.hashing import U64, chain, lower_ascii, span_hashes, windows
from traceloom.llm.packing import _parcels
from traceloom.llm.scratch import Scratch

RUN_SCHEMA = "part int, n int, run binary"
#: Separators of pieces, and of words within a piece.
_BREAK, _GAP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b".,;:!?\n\x0b\x0c\r \t")] = True


class HatTrie:
    """Counts of sequences of ``length`` word ids (32 bits, big-endian), of at most ``most`` kinds.

    The root leads from a first word to a container: a hash table from the bytes of the
    other words to a count. A container of more than ``burst`` kinds becomes a node that
    leads from the second word to smaller containers. The trie stays that shallow.
    """

    def __init__(self, length: int, most: int = 800_000, burst: int = 4096):
        self.length, self.most, self.burst = length, most, burst
        self.roots: dict[int, dict] = {}
        self.open: set[int] = set()  # first words whose container has burst
        self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct sequences, those with the same first word side by side."""
        tails = np.ascontiguousarray(ids[:, 1:].astype(">u4")).view(f"V{4 * (self.length - 1)}").ravel().tolist()
        times = counts.tolist()
        cuts = [0, *(np.flatnonzero(np.diff(ids[:, 0])) + 1).tolist(), len(ids)]
        heads = ids[cuts[:-1], 0].tolist()
        for head, a, b in zip(heads, cuts[:-1], cuts[1:], strict=True):
            node = self.roots.setdefault(head, {})
            if head in self.open:
                for key, n in zip(tails[a:b], times[a:b], strict=True):
                    kid = node.setdefault(key[:4], {})
                    before = len(kid)
                    kid[key[4:]] = kid.get(key[4:], 0) + n
                    self.size += len(kid) - before
                continue
            before = len(node)
            for key, n in zip(tails[a:b], times[a:b], strict=True):
                node[key] = node.get(key, 0) + n
            self.size += len(node) - before
            if len(node) > self.burst and self.length > 2:
                kids: dict[bytes, dict] = {}
                for key, n in node.items():
                    kids.setdefault(key[:4], {})[key[4:]] = n
                self.roots[head] = kids
                self.open.add(head)

    def _kinds(self, head: int) -> int:
        node = self.roots[head]
        return sum(map(len, node.values())) if head in self.open else len(node)

    def _subtree(self, head: int) -> tuple[np.ndarray, np.ndarray]:
        node = self.roots.pop(head)
        if head in self.open:
            self.open.discard(head)
            tails = b"".join(second + rest for second, kid in node.items() for rest in kid)
            times = [n for kid in node.values() for n in kid.values()]
        else:
            tails, times = b"".join(node), list(node.values())
        ids = np.empty((len(times), self.length), dtype=np.int64)
        ids[:, 0] = head
        ids[:, 1:] = np.frombuffer(tails, dtype=">u4").reshape(len(times), -1)
        self.size -= len(times)
        return ids, np.array(times, dtype=np.int64)

    def spill(self, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Takes out whole subtrees, the largest first, until no more than ``down_to`` kinds are left."""
        taken = [(np.empty((0, self.length), np.int64), np.empty(0, np.int64))]
        for head in sorted(self.roots, key=self._kinds, reverse=True):
            if self.size <= down_to:
                break
            taken.append(self._subtree(head))
        return np.concatenate([x for x, _ in taken]), np.concatenate([y for _, y in taken])


class _Words:
    """The words of many texts: fingerprints (of language and word) and how many are left in each one's piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.data = lower_ascii(np.frombuffer(b"\n".join(texts) + b"\n" + bytes(9), dtype=np.uint8)[:-9])
        solid = ~_GAP[self.data]
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if solid[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        names = sorted(set(langs))
        place = {x: k for k, x in enumerate(names)}
        raw = np.frombuffer("".join(names).encode() + bytes(9), dtype=np.uint8)
        stops = np.cumsum([len(x.encode()) for x in names])
        salts = span_hashes(raw, np.concatenate(([0], stops[:-1])), stops, seed=12)
        self.names, self.lang = names, np.array([place[x] for x in langs])[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, side="right")]
        self.prints = chain(salts[self.lang], span_hashes(self.data, self.starts, self.ends)) if len(self.starts) else np.empty(0, U64)
        piece = np.cumsum(_BREAK[self.data], dtype=np.int64)[self.starts]
        last = np.concatenate((np.flatnonzero(np.diff(piece)), [len(piece) - 1])) if len(piece) else np.empty(0, np.int64)
        self.left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(piece)) + 1


def _words(batches):
    for langs, texts in _parcels(batches):
        w = _Words(langs, texts)
        raw = w.data.tobytes()
        distinct, first, count = np.unique(w.prints, return_index=True, return_counts=True)
        spans = zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)
        totals = np.bincount(w.lang, minlength=len(w.names))
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([w.names[k] for k in w.lang[first].tolist()] + w.names, pa.string()), "word": pa.array([raw[a:b].decode() for a, b in spans] + [None] * len(w.names), pa.string()),
                "n": pa.array(np.concatenate((count, totals)), pa.int64()),
            }
        )


def _print(lang: Column, word: Column) -> Column:
    """The fingerprint that stands for a word of a language; 0 for no word."""

    @F.arrow_udf("long")
    def run(langs: pa.Array, words: pa.Array) -> pa.Array:
        out = np.zeros(len(words), dtype=np.int64)
        known = [k for k, x in enumerate(words) if x.is_valid]
        if known:
            made = _Words([langs[k].as_py() for k in known], [words[k].as_py().encode() for k in known])
            out[known] = made.prints.view(np.int64)  # each text is one word
        return pa.array(out)

    return run(lang, word)


def _phrase_prints(flat: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of every n consecutive words."""
    return flat if n == 1 else windows(flat, n)


class _Filter:
    """Bits of the phrases that may be frequent, told by the leading bits of their fingerprints."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def may_hold(self, prints: np.ndarray) -> np.ndarray:
        slot = prints >> U64(64 - self.bits)
        return (self.words[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) > 0


def _filter(found: DataFrame, bits: int) -> _Filter | None:
    """Ors the bits of the frequent phrases in the executors; no more than the filter's 2**bits bits come to the driver."""
    slot = F.shiftrightunsigned("print", 64 - bits)
    parts = found.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - bits}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    if not parts.num_rows:
        return None
    words = np.zeros(1 << (bits - 6), dtype=np.int64)
    words[parts.column("at").to_numpy()] = parts.column("bits").to_numpy()
    return _Filter(words.view(U64), bits)


def _parts(prints: np.ndarray, bits: int) -> np.ndarray:
    """The prefix partition of each phrase: of its first two words (the first, of two), dealt over eight by the word after, so that not all that begins with a common word meets in one task."""
    k, count = min(2, prints.shape[1] - 1), 1 << bits
    prefix = windows(np.ascontiguousarray(prints[:, :k]).ravel(), k)[::k]
    place = (prefix >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(prints), np.int64)
    return (place + (prints[:, k] >> U64(61)).astype(np.int64) * max(1, count >> 3)) % count


def _packed(prints: np.ndarray, counts: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(prints.T).tobytes() + counts.astype("<i8").tobytes())


def _unpacked(blob: bytes, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a run, a row for each place, and its counts."""
    raw = np.frombuffer(expand(blob), dtype=U64).reshape(length + 1, n)
    return raw[:length], raw[length].view(np.int64)


def _runs(prints: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted runs, one for each prefix partition."""
    part = _parts(prints, bits)
    order = np.lexsort((*prints.T[::-1], part))
    prints, counts, part = prints[order], counts[order], part[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.RecordBatch.from_pydict({"part": pa.array(part[cuts[:-1]], pa.int32()), "n": pa.array(np.diff(cuts), pa.int32()), "run": pa.array([_packed(prints[a:b], counts[a:b]) for a, b in spans], pa.binary())})


def _counter(length: int, wanted, bits: int, most: int):
    """Emits the sorted runs that the tries of a task spill."""

    def run(batches):
        held, ids, prints, trie = wanted.value, {}, [], HatTrie(length, most)

        def spilled(down_to=0):
            found, counts = trie.spill(down_to)
            if len(counts):
                yield _runs(np.array(prints, dtype=U64)[found], counts, bits)

        for langs, texts in _parcels(batches):
            w = _Words(langs, texts)
            if len(w.prints) < length:
                continue
            shorter = held.may_hold(_phrase_prints(w.prints, length - 1))
            at = np.flatnonzero(shorter[:-1] & shorter[1:] & (w.left[: len(w.prints) - length + 1] >= length))
            if not len(at):
                continue
            distinct, rank = np.unique(w.prints[at[:, None] + np.arange(length)], return_inverse=True)
            rank = rank.reshape(-1, length)
            code = rank[:, 0].astype(U64)
            for k in range(1, length):
                _, first, code, counts = np.unique(code << U64(32) | rank[:, k].astype(U64), return_index=True, return_inverse=True, return_counts=True)
                code = code.astype(U64)
            known = np.empty(len(distinct), dtype=np.int64)
            for k, x in enumerate(distinct.tolist()):
                if (n := ids.get(x)) is None:
                    n = ids[x] = len(prints)
                    prints.append(x)
                known[k] = n
            step = max(1, most // 4)
            for k in range(0, len(first), step):
                trie.add(known[rank[first[k : k + step]]], counts[k : k + step])
                if trie.size > most:
                    yield from spilled(most // 2)
            if len(prints) > most:  # the ids are given anew
                yield from spilled()
                ids, prints = {}, []
        yield from spilled()

    return run


def _merger(length: int, least: int):
    """Counts of the phrases of one prefix partition that occur ``least`` times or more."""

    def run(table: pa.Table) -> pa.Table:
        columns, counts = [], []
        for n, blob in zip(table.column("n").to_pylist(), table.column("run").to_pylist(), strict=True):
            words, times = _unpacked(blob, n, length)
            columns.append(words)
            counts.append(times)
        prints, times = np.concatenate(columns, axis=1), np.concatenate(counts)
        order = np.lexsort(prints[::-1])
        prints, times = prints[:, order], times[order]
        new = np.flatnonzero(np.concatenate(([True], (prints[:, 1:] != prints[:, :-1]).any(axis=0))))
        total = np.add.reduceat(times, new)
        keep = total >= least
        kept = np.ascontiguousarray(prints[:, new[keep]].T)
        whole = windows(kept.ravel(), length)[::length] if len(kept) else np.empty(0, U64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * length), pa.array(kept.ravel().view(np.int64)))
        return pa.table({"words": lists, "n": pa.array(total[keep], pa.int64()), "print": pa.array(whole.view(np.int64))})

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = 5, least: int = 100, filter_bits: int = 27, most: int = 800_000) -> tuple[DataFrame, DataFrame]:
    """Frequent words (lang, word, print, n, total) and frequent phrases of two words or more (words, n), by language.

    A word's print stands for language and word, so phrases are lists of prints. Null
    texts are empty, a null language is ``und``; other columns are ignored, rows that
    are equal count each. A task's trie holds at most ``most`` phrases and a quarter, a
    merging task the runs of one prefix partition.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = corpus_bytes(docs, text) / 6
    bits = bits_for(items, bucket_size(items))
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    every = rows.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    some = every.where(F.col("word").isNull() | (F.col("n") >= least)).withColumn("print", _print(F.col("lang"), F.col("word")))
    some = scratch.save(some, "words")
    totals = some.where("word IS NULL").select("lang", F.col("n").alias("total"))
    words = some.where("word IS NOT NULL").join(totals, "lang")
    found, phrases = some.where("word IS NOT NULL"), None
    for length in range(2, most_words + 1):
        held = _filter(found, filter_bits)
        if held is None:
            break
        wanted = spark.sparkContext.broadcast(held)
        runs = rows.mapInArrow(_counter(length, wanted, bits, most), RUN_SCHEMA)
        found = scratch.save(runs.groupBy("part").applyInArrow(_merger(length, least), "words array<long>, n long, print long"), f"phrases{length}")
        wanted.destroy()
        phrases = found.select("words", "n") if phrases is None else phrases.unionByName(found.select("words", "n"))
    return words, spark.createDataFrame([], "words array<long>, n long") if phrases is None else phrases


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact: products of 38 decimal digits, integer division."""
    wide = lambda x, digits: x.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(F.lit(1000) * a, 19) * wide(n, 19), wide(left, 19) * wide(right, 19))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = 5, least: int = 100, percent: int = 100, top: int = 2000, **more) -> DataFrame:
    """Each language's ``top`` phrases by their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer frequent one holds it and has ``percent`` of its occurrences
    or more. It is enough to look at phrases of one word more: what lies between the two
    occurs no less often than the longer. See ``phrase_counts`` for rows without text or language.
    """
    words, phrases = phrase_counts(docs, text, lang, most_words, least, **more)
    singles = words.select(F.array("print").alias("words"), "n", "lang", "total")
    counts = singles.unionByName(phrases.select("words", "n", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("total")))
    size = F.size("words")
    cuts = phrases.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    left, right = counts.select(F.col("words").alias("first"), F.col("n").alias("l"), "lang", "total"), counts.select(F.col("words").alias("rest"), F.col("n").alias("r"))
    known = cuts.join(left, "first").join(right, "rest").groupBy("words", "a").agg(F.max("lang").alias("lang"), F.max("total").alias("n"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    worst = F.array_min(F.transform("cuts", lambda c: F.struct(_score(F.col("a"), F.col("n"), c["l"], c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    shorter = phrases.where(size > 2).select(F.col("n").alias("longer"), F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words")).groupBy("words").agg(F.max("longer").alias("longer"))
    scored = known.withColumn("worst", worst).join(shorter, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    rows = scored.select("lang", "words", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), "n", F.col("worst.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc()]
    best = rows.withColumn("rank", F.rank().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)  # all that tie for the last place stay until phrases decide
    spelled = best.select("*", F.posexplode("words").alias("at", "print")).join(words.select("print", "word"), "print")
    texts = spelled.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = texts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, F.col("phrase"))).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_collocations": op12_collocations}

ORACLES = {
    "op12_collocations": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), lists AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces
), starts AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM lists WHERE len(words) > 0
), phrases AS (
    SELECT lang, unnest(list_transform(range(0, least(5, len(words) - i + 1)), lambda k: {'size': k + 1, 'words': words[i:i + k]})) AS p FROM starts
), counts AS (
    SELECT lang, p.size AS size, p.words AS words, CAST(count(*) AS HUGEINT) AS f FROM phrases GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM counts WHERE size > 1 AND f >= 100
), cuts AS (
    SELECT c.lang, c.size, c.words, c.f AS a, k, f1.f AS l, f2.f AS r, n, (1000 * c.f * n) // (f1.f * f2.f) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN totals USING (lang) JOIN counts f1 ON f1.lang = c.lang AND f1.words = c.words[1:k] JOIN counts f2 ON f2.lang = c.lang AND f2.words = c.words[k + 1:]
), worst AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), parts AS (
    SELECT lang, f, words[i:j] AS part FROM (SELECT *, unnest(range(i + 1, size + 1)) AS j FROM (SELECT *, unnest(range(1, size)) AS i FROM candidates WHERE size > 2)) WHERE j - i + 1 < size
), longer AS (
    SELECT lang, part AS words, max(f) AS f FROM parts GROUP BY ALL
), kept AS (
    SELECT w.*, array_to_string(w.words, ' ') AS phrase FROM worst w LEFT JOIN longer o ON o.lang = w.lang AND o.words = w.words WHERE o.f IS NULL OR 100 * o.f < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
""",
}
