"""Byte, word and set deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from traceloom.llm import exchange, hashing
from traceloom.llm.components import components
from traceloom.llm.jaccard_join import jaccard_components
from traceloom.llm.scratch import Scratch
from traceloom.llm.substring_dedup import op8_substring_dedup, remove_repeated_windows
from traceloom.llm.suffix_dedup import COVER, PERIOD, op2_suffix_array_dedup, remove_repeated_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def byte_removal(texts: list[str], length: int):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        yield len(x), sum(gone), len([p for p in bytes(gone).split(b"\0") if p]), hashlib.sha256(kept).hexdigest()


def word_removal(texts: list[str], window: int):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


def shingles(text, n=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(texts: dict, percent=85):
    sets, up = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(texts)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(sets[k]), root(k)) for k in texts}


def test_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_packing_of_keys():
    keys = np.unique(np.array([0, 1, 5, 2**63, 2**64 - 1, 77], dtype=np.uint64))
    assert (exchange.unpack(exchange.pack(keys)) == keys).all()


def test_windows_depend_on_all_items_and_length():
    h = hashing.mix(np.arange(50, dtype=np.uint64))
    for n in (1, 2, 3, 4, 35):
        w = hashing.windows(h, n)
        assert len(w) == 50 - n + 1
        assert len(set(w.tolist())) == len(w)
        assert (hashing.windows(h[3:], n) == w[3:]).all()
    assert hashing.windows(h, 4)[0] != hashing.windows(h, 3)[0]


def thue_morse(bits: int) -> tuple[str, str]:
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_regular_words_have_their_own_fingerprints(spark):
    """Thue-Morse words and their complements collide in any polynomial modulo a power of two."""
    for bits in (5, 6, 10, 12):
        one, other = thue_morse(bits)
        data = np.frombuffer(f"{one} {other}".encode(), dtype=np.uint8)
        for seed in (0, hashing.SECOND):
            a, b = hashing.span_hashes(data, *hashing.word_bounds(data), seed)
            assert a != b
    one, other = thue_morse(10)
    rows = [(1, one), (2, other), (3, " ".join([*map(str, range(34)), one])), (4, " ".join([*map(str, range(34)), other]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}  # 31 of 33 shingles
    assert {r.n_removed for r in remove_repeated_windows(df).collect()} == {0}


def test_spans_of_all_lengths():
    random.seed(3)
    data = np.frombuffer(bytes(random.choices(b"ab", k=3000)), dtype=np.uint8)
    spans = [(i, i + n) for n in (*range(1, 20), 63, 64, 65, 200) for i in range(0, 2700, 9)]
    starts, ends = map(np.array, zip(*spans, strict=True))
    h = hashing.span_hashes(data, starts, ends)
    by_text: dict = {}
    for (a, b), x in zip(spans, h.tolist(), strict=True):
        by_text.setdefault(data[a:b].tobytes(), set()).add(x)
    assert all(len(x) == 1 for x in by_text.values())
    assert len(set(h.tolist())) == len(by_text)


def test_equal_keys_with_other_bits_are_not_repeats():
    key = lambda *x: np.array(x, dtype=np.uint64)
    more = lambda *x: np.array(x, dtype=np.uint32)
    got = exchange.repeated([(key(1, 2, 2), more(5, 1, 2)), (key(1, 2, 9), more(6, 2, 0)), (key(7), more(3))])
    assert [x.tolist() for x in got] == [[False, False, True], [False, True, False], [False]]
    keys, bits, back, often = exchange.distinct_pairs(key(4, 4, 3, 4), more(1, 2, 0, 1))
    assert (keys.tolist(), bits.tolist(), back.tolist(), often.tolist()) == ([3, 4, 4], [0, 1, 2], [1, 2, 0, 1], [False, True, False])


def test_very_long_text(spark):
    """One text of several chunks' size, which holds the others, and one of a single repeated byte."""
    random.seed(2)
    small = [" ".join(random.choices("abcdefgh", k=700)) for _ in range(3)]
    docs = {1: " ".join(random.choices(["xy", "z", "wv"], k=60_000)) + " ".join(small), 2: small[1], 3: "q" * 300_000, 4: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_windows(df, chunk_bytes=20_000, bucket_items=2000).collect()}
    assert got == dict(zip(docs, word_removal(list(docs.values()), 35), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in remove_repeated_bytes(df, chunk_bytes=20_000, bucket_items=2000).collect()}
    assert got == {k: x[:2] for k, x in zip(docs, byte_removal([(t or "") for t in docs.values()], 400), strict=True)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, chunk_bytes=20_000).collect()} == groups(docs)


def test_blocks_of_a_common_first_gram(spark):
    """Many sets that share rare n-grams only with some: pairs beyond one block, none of them lost."""
    random.seed(11)
    head = [f"h{i}" for i in range(12)]
    docs = {}
    for k in range(700):
        tail = [f"t{random.randrange(4)}x{i}" for i in range(6 + k % 9)]
        docs[k] = " ".join(head + tail)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, chunk_bytes=9000).collect()} == groups(docs)


def test_components_that_are_not_final_are_an_error(spark):
    import pytest

    path = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long").repartition(7)
    with pytest.raises(RuntimeError, match="not final"):
        components(path, Scratch(spark), "t", 20, most_steps=1)


def test_op2_equals_brute_force(spark, data, texts):
    got = {r[0]: tuple(r)[1:] for r in op2_suffix_array_dedup(spark, data).collect()}
    assert got == dict(zip(texts, byte_removal(list(texts.values()), 400), strict=True))


def test_op2_leaves_a_shared_passage_of_over_50_words_that_is_shorter_than_its_length(spark):
    """As are all items of ``benchmark``: a passage goes once a string of ``length`` bytes fits into it, however many words it has."""
    random.seed(21)
    word = lambda low, high: "".join(random.choices("abcdefghijklmnop", k=random.randrange(low, high)))
    passage = (" ".join(word(5, 8) for _ in range(70)))[:398] + "."
    assert len(passage) == 399
    assert len(WORD.findall(passage)) > 50
    own = [" ".join(word(3, 9) for _ in range(120)) for _ in range(4)]
    docs = {1: f"{own[0]}0{passage}1", 2: f"{own[1]}2{passage}3", 3: f"{own[2]}4{passage}5", 4: own[3]}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for length, gone in ((400, 0), (399, 399), (281, 399)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(df, length=length).collect()}
        assert got == dict(zip(docs, byte_removal(list(docs.values()), length), strict=True))
        assert [got[k][1] for k in docs] == [gone, gone, gone, 0]


def test_op8_equals_brute_force(spark, data, texts):
    got = {r[0]: tuple(r)[1:] for r in op8_substring_dedup(spark, data).collect()}
    assert got == dict(zip(texts, word_removal(list(texts.values()), 35), strict=True))


def test_repeats_over_small_alphabets_and_many_chunks(spark):
    random.seed(5)
    block = ["".join(random.choices("ab c", k=500)) for _ in range(4)]
    docs = ["".join(random.choices([*block, "x", "é" * 300, "ab" * 400], k=random.randrange(5))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(df, chunk_bytes=2000, bucket_items=500).collect()}
    assert got == dict(enumerate(byte_removal(docs, 400)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_windows(df, window=5, chunk_bytes=2000, bucket_items=500).collect()}
    assert got == dict(enumerate(word_removal(docs, 5)))


def test_op6_equals_brute_force(spark, data, texts):
    df = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, chunk_bytes=50_000).collect()}
    assert got == groups(texts)


def test_op6_chains_of_near_copies(spark):
    random.seed(9)
    docs = {}
    for family in range(6):
        words = [f"w{random.randrange(30 + 200 * family)}" for _ in range(60 + 40 * family)]
        for _ in range(14):
            docs[len(docs)] = " ".join(words)
            for _ in range(random.randrange(3)):
                words[random.randrange(len(words))] = f"v{random.randrange(50)}"
    docs |= {100: "one two", 101: "ONE two", 102: "one", 103: "", 104: " "}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, chunk_bytes=3000).collect()}
    assert got == groups(docs)
    assert got[101] == (1, 100)
    assert got[104] == (0, 104)


def test_odd_rows(spark, odd, none):
    rows = odd.select("text").collect()
    got = sorted((r.n_bytes, r.n_removed) for r in remove_repeated_bytes(odd).collect())
    assert got == sorted(x[:2] for x in byte_removal([r.text for r in rows], 400))
    got = sorted((r.n_words, r.n_removed) for r in remove_repeated_windows(odd, window=3).collect())
    assert got == sorted(x[:2] for x in word_removal([r.text for r in rows], 3))
    found = jaccard_components(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found) == [(0, 6), (1, 1), (2, 2), (3, 3), (4, 3), (6, 6), (6, 6), (7, 7), (8, 8)]
    assert sum(r.keeper for r in found) == 6
    assert remove_repeated_bytes(none).count() == remove_repeated_windows(none).count() == jaccard_components(none).count() == 0


def test_components_in_one_task_and_in_many(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 540)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    for bound in (10_000, 60):
        assert {r.node: r.label for r in components(df, Scratch(spark), "t", bound).collect()} == {x: root(x) for x in up}


def test_pipeline_stage_drops_near_copies_from_four_fifths(spark):
    """Copies that lack 18 and 25 % of the text at its end: 5-word similarities of 0.82 and 0.74."""
    from corpus_pipeline import drop_near_copies

    words = [f"w{i}" for i in range(400)]
    docs = {1: words, 2: words[:328], 3: words[:298], 4: [f"x{i}" for i in range(90)]}
    for a, b, low, high in ((1, 2, 80, 85), (1, 3, 70, 80)):
        x, y = (shingles(" ".join(docs[k]), 5) for k in (a, b))
        assert low <= 100 * len(x & y) / len(x | y) < high
    del docs[3]
    kept = drop_near_copies(spark, spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {1, 4}
    docs[2] = words[:298]
    kept = drop_near_copies(spark, spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {1, 2, 4}
