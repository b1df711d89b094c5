"""N-gram Jaccard join with rare-first prefix filtering (operator 6).

Every document is the set of its word n-grams. N-grams are ordered by how common they
are, rare ones first; two sets of the wanted similarity share one among their first
few, the prefix. How common an n-gram is comes from a merged sketch over all documents;
any order that all tasks agree on is right, so an estimate will do. An n-gram that no
other document can hold (an estimate of one, and once in its chunk) fills its place in
the prefix, but is joined with nothing. Pairs are found by equal prefix n-grams, thinned by length,
position and suffix filters, and each is verified once on whole sets.

Documents with equal sets (by 128 bits) are one class, named by the row of one of them.
Classes are joined in two rounds. First each prefix n-gram's classes are compared with
one leader; those found similar form components. Then only classes that share a prefix
n-gram and lie in different components are compared, so that a large group of near
copies costs one comparison each, and no link that would join two components is lost.
The second round works on blocks: a n-gram's classes are cut by size, so that only
neighbouring sizes meet, and into blocks of a few hundred. A task gets two blocks at a
time and hands on only the pairs that pass all filters.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm import exchange as X
from traceloom.llm import hashing as H
from traceloom.llm.components import components
from traceloom.llm.scratch import Scratch, looked_up
from traceloom.llm.substring_dedup import separated

U64 = np.uint64
SIGNATURES = "doc_id long, row long, text_sha string, n_shingles long, node long, node2 long, tokens array<long>, places array<int>, bins array<int>, grams binary"
BINS = 32
#: Bits of each n-gram that verification compares.
KEPT_BITS = 56


class _Sets:
    """The distinct n-grams of each document of a chunk, by document, then value."""

    def __init__(self, chunk: X.Chunk, n: int):
        data = H.lower_ascii(separated(chunk))
        starts, ends = H.word_bounds(data)
        owner = np.searchsorted(chunk.starts + np.arange(len(chunk.ids)), starts, side="right") - 1
        words = H.span_hashes(data, starts, ends) if len(starts) else np.empty(0, U64)
        count = np.bincount(owner, minlength=len(chunk.ids))
        every = H.windows(words, n)
        at = np.flatnonzero(owner[: len(every)] == owner[n - 1 : n - 1 + len(every)]) if len(every) else np.empty(0, np.int64)
        docs, grams = [owner[at]], [every[at]]
        for k in range(1, n):  # the whole of a text of fewer words
            first = np.flatnonzero((count[owner] == k) & (np.diff(owner, prepend=-1) > 0)) if len(owner) else np.empty(0, np.int64)
            if len(first):
                docs.append(owner[first])
                grams.append(H.windows(words, k)[first])
        doc, gram = np.concatenate(docs), np.concatenate(grams)
        order = np.argsort(gram)
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
        doc, gram = doc[order], gram[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        self.doc, self.gram = doc[new], gram[new]
        self.cuts = np.searchsorted(self.doc, np.arange(len(chunk.ids) + 1))


def _chunk_counts(lists: list[tuple], part: int) -> list[np.ndarray]:
    """In how many chunks each cell occurs, up to 255: the merged sketch of one slice."""
    lists = [x for x, _ in lists]
    counters = np.zeros(int(max(x[-1] for x in lists)) + 1, dtype=np.uint8)
    for x in lists:
        counters[x] += counters[x] < 255
    return [counters[x] for x in lists]


def signatures(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, chunk_bytes: int | None, bucket_items: int | None, counters: int) -> DataFrame:
    """A row for each document: set size and class, and, if another document may be similar, prefix n-grams and the whole set."""
    items = max(1, X.corpus_bytes(docs, text) // 6)
    chunk_bytes, bucket_items = chunk_bytes or X.chunk_size(items, 6), bucket_items or X.bucket_size(items)
    bits = max(16, (items * counters - 1).bit_length())
    slices = X.bits_for(items, bucket_items)
    chunks = X.chunked(docs, doc_id, text, chunk_bytes)

    def cells(grams):
        return H.mix(grams) >> U64(64 - bits)

    def sketch(chunk):
        return [X.requests(chunk.chunk_id, np.unique(cells(_Sets(chunk, n).gram)), slices, bits)]

    def sign(chunk, replies):
        s = _Sets(chunk, n)
        distinct, back = np.unique(cells(s.gram), return_inverse=True)
        common = X.read_flags(replies, 1, as_bits=False)[back] if len(distinct) else np.empty(0, np.uint8)
        _, place, often = np.unique(s.gram, return_inverse=True, return_counts=True) if len(s.gram) else (None, np.empty(0, np.int64), np.empty(0, np.int64))
        shared = (common > 1) | (often[place] > 1)
        kinds = H.mix(s.gram ^ U64(0x5DEECE66D))
        raw = chunk.data.tobytes()
        out = []
        for k, (a, b) in enumerate(zip(s.cuts[:-1].tolist(), s.cuts[1:].tolist(), strict=True)):
            size = b - a
            sha = hashlib.sha256(raw[chunk.starts[k] : chunk.ends[k]]).hexdigest()[:16]
            row = (chunk.chunk_id << 16) | k
            mine = s.gram[a:b]
            node, node2 = (int(x) for x in (kinds[a:b].sum(dtype=U64), H.mix(kinds[a:b]).sum(dtype=U64)))
            tokens = places = bins = grams = None
            prefix = size - (percent * size + 99) // 100 + 1
            if size:
                order = np.lexsort((mine, common[a:b]))[:prefix]
                places = np.flatnonzero(shared[a:b][order])
                if len(places):
                    tokens = mine[order[places]].view(np.int64)
                    bins = np.bincount((kinds[a:b] >> U64(59)).astype(np.int64), minlength=BINS).astype(np.int32)
                    grams = X.pack(np.unique(mine >> U64(64 - KEPT_BITS)))
                else:
                    places = None
            out.append((sha, row, size, node, node2, tokens, places, bins, grams))
        sha, row, size, node, node2, tokens, places, bins, grams = zip(*out, strict=True)
        signed = lambda x: pa.array(np.array(x, dtype=U64).view(np.int64))
        return [pa.RecordBatch.from_pydict({
            "doc_id": chunk.id_column(), "row": pa.array(row, pa.int64()), "text_sha": list(sha), "n_shingles": pa.array(size, pa.int64()), "node": signed(node), "node2": signed(node2),
            "tokens": pa.array(tokens, pa.list_(pa.int64())), "places": pa.array(places, pa.list_(pa.int32())), "bins": pa.array(bins, pa.list_(pa.int32())), "grams": pa.array(grams, pa.binary()),
        })]

    return X.with_replies(chunks, X.answer(X.send(chunks, sketch), 1, _chunk_counts, as_bits=False), sign, SIGNATURES)


def _may_match(a: str, b: str, percent: int) -> Column:
    """Length and positional filter for two postings of one n-gram, if it is the first that the sets share."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}place", f"{b}place"))
    rest = F.least(na - pa_, nb - pb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * rest >= percent * (na + nb))


#: Classes of one n-gram and size that are compared at a time.
BLOCK = 256


def _block_pairs(percent: int):
    """Of two blocks of classes with one n-gram in common: the pairs (a, b) that length, positional and suffix filters leave.

    Suffix filter: parts of the two sets by a fixed partition of the n-grams; the smaller part bounds what they share there.
    """

    def run(batches):
        for batch in batches:
            (x0, xs), (y0, ys) = ((c.offsets.to_numpy(), c.flatten()) for c in (batch.column("x"), batch.column("y")))
            base_x, base_y = x0[0], y0[0]
            (xv, yv) = ({f: s.field(f).to_numpy(zero_copy_only=False) for f in ("node", "n", "place", "part")} for s in (xs, ys))
            xb, yb = (s.field("bins").flatten().to_numpy().reshape(-1, BINS) for s in (xs, ys))
            found = []
            for k, own in enumerate(batch.column("own").to_pylist()):
                p, q = (slice(o[k] - base, o[k + 1] - base) for o, base in ((x0, base_x), (y0, base_y)))
                n, m = xv["n"][p][:, None], yv["n"][q][None, :]
                rest = np.minimum(n - xv["place"][p][:, None], m - yv["place"][q][None, :])
                good = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * rest >= percent * (n + m))
                good &= xv["part"][p][:, None] != yv["part"][q][None, :]
                if own:
                    good &= xv["node"][p][:, None] < yv["node"][q][None, :]
                i, j = np.nonzero(good)
                if len(i):
                    most = np.minimum(xb[p][i], yb[q][j]).sum(axis=1)
                    keep = (100 + percent) * most >= percent * (xv["n"][p][i] + yv["n"][q][j])
                    found.append(np.sort(np.stack([xv["node"][p][i[keep]], yv["node"][q][j[keep]]]), axis=0))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return run


def _pairs_across(across: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs of classes (token, node, n, place, part, bins) of one token and different parts that may be similar."""
    # Sizes of one step differ by less than the least ratio, so similar sets are one step apart at most.
    step = F.col("n") if percent >= 100 else F.floor(F.log("n") / (1.0001 * math.log(100 / percent))).cast("long")
    rows = across.withColumn("step", step)
    sizes = rows.groupBy("token", "step").agg(F.count(F.lit(1)).alias("c")).withColumn("s", F.ceil(F.col("c") / BLOCK).cast("int"))
    dealt = looked_up(rows, sizes, ["token", "step"], "c", total).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    blocks = dealt.groupBy("token", "step", "blk").agg(F.first("s").alias("s"), F.collect_list(F.struct("node", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"), "part", "bins")).alias("x"))
    other = blocks.select("token", F.col("step").alias("to"), F.col("blk").alias("with"), F.col("x").alias("y"))
    same = blocks.select("token", F.col("step").alias("to"), F.explode(F.sequence("blk", F.col("s") - 1)).alias("with"), "x", (F.col("with") == F.col("blk")).alias("own"))
    after = sizes.select("token", (F.col("step") - 1).alias("step"), F.col("s").alias("next"))
    above = blocks.join(after, ["token", "step"]).select("token", (F.col("step") + 1).alias("to"), F.explode(F.sequence(F.lit(0), F.col("next") - 1)).alias("with"), "x", F.lit(False).alias("own"))
    met = same.where("NOT own OR size(x) > 1").unionByName(above).join(other, ["token", "to", "with"])
    return met.select("x", "y", "own").mapInArrow(_block_pairs(percent), "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar. The set of a node in very many pairs is joined in salted parts."""
    load = pairs.groupBy("b").count().select("b", F.ceil(F.col("count") / 500).cast("int").alias("parts"))
    salted = pairs.join(load, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    right = sets.join(load, F.col("node") == F.col("b")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select("b", "salt", F.col("grams").alias("gb"), F.col("n").alias("nb"))
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"), F.col("n").alias("na"))
    both = salted.select("a", "b", "salt").join(left, "a").join(right, ["b", "salt"])

    def run(batches):
        for batch in batches:
            keep, held = [], {}
            for b, ga, gb, na, nb in zip(*(batch.column(k).to_pylist() for k in ("b", "ga", "gb", "na", "nb")), strict=True):
                if b not in held:
                    held = {b: X.unpack(gb)}
                x, y = X.unpack(ga), held[b]
                at = np.searchsorted(y, x)
                same = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                keep.append(100 * same >= percent * (na + nb - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ga", "gb", "na", "nb").mapInArrow(run, "a long, b long")


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, chunk_bytes: int | None = None, bucket_items: int | None = None,
    counters: int = 8, scratch: Scratch | None = None,
) -> DataFrame:
    """One row for each document: doc_id, row, text_sha, n_shingles, node (its class), component_id, keeper.

    Two documents link if the n-grams that both have are ``percent`` hundredths or more of
    those that either has. component_id is the smallest doc_id that links reach. A text of
    fewer than ``n`` words is one n-gram, the whole; one without words, or null, links with
    nothing, not even its like. Rows that share an id are separate documents; a null id is
    never a component's name unless all its documents have none; ids are cast to long. ``keeper`` marks one row of
    each component, of the smallest id.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    signed = scratch.save(signatures(docs, doc_id, text, n, percent, chunk_bytes, bucket_items, counters), "signatures")
    total = signed.count()
    some = signed.where("n_shingles > 0")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "row")).alias("least")
    classes = scratch.save(some.groupBy("node", "node2").agg(least, F.count(F.lit(1)).alias("members")), "classes")
    held = signed.where(F.col("tokens").isNotNull()).select("row", F.col("n_shingles").alias("n"), "tokens", "places", "bins", "grams")
    reps = scratch.save(held.join(classes.select(F.col("least.row").alias("row")), "row").withColumnRenamed("row", "node"), "representatives")
    posting = scratch.save(reps.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select(F.col("t.tokens").alias("token"), "node", "n", F.col("t.places").alias("place")), "postings")
    sets, postings = reps.select("node", "n", "grams"), posting.count()

    leaders = posting.groupBy("token").agg(F.min(F.struct("place", "node", "n")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", F.col("l.node").alias("b"), F.col("l.n").alias("l_n"), F.col("l.place").alias("l_place"), "c")
    near = looked_up(posting.withColumnsRenamed({"n": "m_n", "place": "m_place", "node": "a"}), leaders, ["token"], "c", postings).where("a <> b").where(_may_match("m_", "l_", percent)).select("a", "b").distinct()
    near = scratch.save(near, "pairs-1")
    one = scratch.save(_verified(near, sets, percent), "edges-1")
    parts = scratch.save(components(one, scratch, "star-1"), "parts-1")

    placed = posting.join(parts.withColumnRenamed("label", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    mixed = placed.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("token", F.lit(True).alias("mixed"), "c")
    across = looked_up(placed, mixed, ["token"], "c", postings).where("mixed").drop("mixed").join(reps.select("node", "bins"), "node")
    pairs = _pairs_across(scratch.save(across, "across"), percent, postings)
    pairs = scratch.save(pairs.join(near, ["a", "b"], "left_anti").join(near.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "pairs-2")
    two = scratch.save(_verified(pairs, sets, percent), "edges-2")
    label = scratch.save(components(one.union(two), scratch, "star-2"), "parts-2")

    named = classes.withColumn("row", F.col("least.row")).join(label.withColumnRenamed("node", "row"), "row", "left")
    names = named.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("c"))
    by_class = looked_up(named, names, ["label"], "c", total).select("node", "node2", F.coalesce("top", "least").alias("top"), "members")
    out = looked_up(signed, scratch.save(by_class, "tops"), ["node", "node2"], "members", total).withColumn("alone", F.col("n_shingles") == 0)
    lead = F.when(~F.col("alone") & (F.col("top.id") < F.lit((1 << 63) - 1)), F.col("top.id"))
    return out.select(
        "doc_id", "row", "text_sha", "n_shingles", "node", F.when(F.col("alone"), F.col("doc_id")).otherwise(lead).alias("component_id"),
        (F.col("alone") | (F.col("row") == F.col("top.row"))).alias("keeper"),
    )


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


_ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLES = {"op6_ngram_jaccard_join": _ORACLE}
