"""Fill-in-middle, phrases and files of token ids."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from traceloom.llm import collocations, fill_middle, registry, token_files


def same_as_sql(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_op11_equals_sql(spark, duck, data):
    same_as_sql(spark, duck, data, "op11_fill_in_middle")


def plain_units(text):
    """Line by line, without an expression."""
    out = text.split("\n")
    return [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] else [])


def by_hand(doc, text):
    text = text or ""
    units = plain_units(text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


HARD = ["", None, "\n", "a", "a\n", "\n\nb", "a\r\nb c\x0bd\n", "x<P\n>y\nz<", "a\n<S>b\nc", "é\n😀\nß", "<\nP>\n<", "l\n" * 5000 + "end", "w" * 200_000]


def test_middle_by_hand_and_back(spark):
    rows = [(i, t, "x") for k in range(4) for i, t in enumerate(HARD, 100 * k)] + [(None, "a\nb\nc", "y")] * 2 + [(-3, "a\nb\nc", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    made = fill_middle.fill_middle(docs)
    got = fill_middle.restored(made, F.col("fim.output"), F.col("fim.form")).collect()
    assert len(got) == len(rows)
    assert {r.fim.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r.fim) == by_hand(r.doc_id, r.text)
        assert r.restored == (r.text or "")


def test_middle_of_odd_rows(spark, odd, none):
    made = fill_middle.fill_middle(odd)
    assert made.count() == odd.count() and made.columns == [*odd.columns, "fim"]
    assert fill_middle.fill_middle(none).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_middle(odd, column="Words")
    with pytest.raises(ValueError):
        fill_middle.fill_middle(odd, markers=("<P>", "<P>>", "<M>"))


def test_other_units_and_rates(spark):
    docs = spark.createDataFrame([(k, "ab cd ef") for k in range(400)], "doc_id long, text string")
    some = fill_middle.fill_middle(docs, unit=r"\S++\s*+", percent=25, spm_percent=0, markers=("[a]", "[b]", "[c]"))
    counts = {r.form: r["count"] for r in some.groupBy("fim.form").count().collect()}
    assert set(counts) == {"plain", "psm"} and 60 < counts["psm"] < 140
    assert {r.n for r in some.select("fim.n").collect()} == {3}


def test_op12_equals_sql(spark, duck, data):
    same_as_sql(spark, duck, data, "op12_collocations")


def by_counting(rows, least, percent, top, most_words=5):
    """Phrases by plain counting, and scores in whole numbers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longest[p[i:j]] = max(longest[p[i:j]], a)
        found = []
        for p, a in candidates.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longest[p] < percent * a:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, phrase.decode(), -a, left, right, n[lang], -score) for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def generated(seed, n=60):
    random.seed(seed)
    words = ["a", "B", "É", "ß", "don't", "x" * 70, "😀", "-", "of", "the"]
    joins = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]
    rows = [(random.choice(["en", "fr", None, "und", ""]), "".join(random.choice(words) + random.choice(joins) for _ in range(random.randrange(80)))) for _ in range(n)]
    return rows + [("en", None), (None, None), ("en", ""), ("en", " .\n"), ("fr", "of the a b É")] + [("en", "one two three four five six")] * 7


@pytest.mark.parametrize(("least", "percent", "top", "most"), [(3, 100, 2000, 800_000), (2, 60, 5, 40), (7, 100, 3, 11)])
def test_phrases_by_counting(spark, least, percent, top, most):
    rows = generated(least)
    docs = spark.createDataFrame([(lang, text, 1, "w") for lang, text in rows], "lang string, text string, n long, words string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(docs, least=least, percent=percent, top=top, most=most).collect()))
    assert got == by_counting(rows, least, percent, top) and got


def test_phrases_of_odd_rows(spark, odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(map(tuple, collocations.collocations(odd, least=2).collect())) == by_counting(rows, 2, 100, 2000)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(odd, least=10**6).count() == 0


def test_trie_bursts_and_spills_whole_subtrees():
    rng, trie, want = np.random.default_rng(3), collocations.HatTrie(3, most=500, burst=8), Counter()
    spilled, spills = Counter(), 0
    for _ in range(30):
        ids, counts = np.unique(rng.integers(0, 12, (200, 3)), axis=0, return_counts=True)
        want.update(dict(zip(map(tuple, ids.tolist()), counts.tolist(), strict=True)))
        trie.add(ids, counts)
        assert trie.open
        if trie.size > trie.most:
            before = set(trie.roots)
            out, times = trie.spill(100)
            assert trie.size <= 100 and not {x for x in out[:, 0].tolist()} & set(trie.roots) and set(trie.roots) < before
            spilled.update(dict(zip(map(tuple, out.tolist()), times.tolist(), strict=True)))
            spills += 1
    out, times = trie.spill()
    spilled.update(dict(zip(map(tuple, out.tolist()), times.tolist(), strict=True)))
    assert spilled == want and spills > 1 and trie.size == 0 and not trie.roots


def test_scores_pass_64_bits(spark):
    a, n, left, right = 9_000_000_000_000, 90_000_000_000_000, 9_500_000_000_001, 9_900_000_000_007
    got = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(collocations._score(*map(F.col, ("a", "n", "l", "r"))).alias("s")).first().s
    assert got == 1000 * a * n // (left * right)


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole(bpe):
    """Ids of a whole text by the library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe)
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows, whole):
    out, start = [], 0
    for doc, text in rows:
        ids = whole(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4"))))
        start += len(ids)
    return out


BYTES = ["", " ", "a", " a  b ", "don't we'll I'D x's'", "a  b  c", "　 x", "é à×b÷ ÿ.", "12.5, 3rd—x … y", "<|endoftext|>", "a <|endoftext|>b  <|end <|<|endoftext|>|> c", "\r\n\t x\x0b\x0c y\x85 z", "😀😀 a👍🏽!", "\x00\x1c a\x1d b", "a" * 3000, "\n" * 700 + "x", " !?.,\n\n  'tis", "x  y​ z", "œuvre, Œ. ß?", "é. ñ!"]


def test_parts_have_the_ids_of_whole_texts(bpe, whole):
    random.seed(5)
    alphabet = [*"ab Z9.,'-<|>\n\t", "  ", "é", "×", "œ", " ", "　", "😀", "́", "'s", "'ll", "<|endoftext|>", "\x85", "\x1c", "٣"]
    texts = BYTES + ["".join(random.choices(alphabet, k=random.randrange(60))) for _ in range(3000)]
    mine = token_files.ByteTokenizer(bpe, most=400)
    for _ in range(2):
        ids, ends = mine.encode([t.encode() for t in texts], 2)
        for text, low, high in zip(texts, [0, *ends.tolist()], ends.tolist(), strict=False):
            assert ids[low:high].tolist() == whole(text), text


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes_back(unit, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    planes = token_files.to_planes(ids, unit)
    assert len(planes) == (4 if unit == "byte" else 32)
    assert token_files.from_planes(planes, n).tolist() == ids.tolist()
    if unit == "bit" and n == 1000:
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(planes[5]), np.uint8), count=n, bitorder="little")
        assert bits.tolist() == ((ids >> 5) & 1).tolist()


def test_joined_checksums():
    random.seed(2)
    for _ in range(50):
        a, b = random.randbytes(random.randrange(40)), random.randbytes(random.randrange(3000))
        assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_op13_equals_whole_texts(spark, texts, whole, data):
    got = registry.QUERIES["op13_token_files"](spark, data)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == expected(sorted(texts.items()), whole)


@pytest.mark.parametrize(("unit", "block"), [("byte", 8), ("bit", 64), ("byte", 1 << 17)])
def test_token_files_back(spark, bpe, whole, tmp_path, unit, block):
    rows = [(k, t) for k, t in enumerate(BYTES, -3)] + [(None, "a b"), (4, "same"), (4, "same"), (10**15, None)]
    random.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, part long").repartition(3)
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, path, bpe, block=block, unit=unit, parts=3)
    got = token_files.read_documents(spark, path).orderBy("start").collect()
    texts = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got}
    assert texts == {(d, len(whole(t)), zlib.crc32(np.array(whole(t), dtype="<u4"))) for d, t in rows}
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    total = sum(r.n_tokens for r in got)
    index = spark.read.parquet(f"{path}/index").orderBy("first").collect()
    assert sum(r.n for r in index) == total and all(r.n <= block and len(r.n_bytes) == (4 if unit == "byte" else 32) for r in index)
    some = token_files.read_range(spark, path, total // 3, total // 3 + 50)
    flat = [x for r in some.orderBy("first").collect() for x in r.ids]
    assert len(flat) == 50 and flat == [x for r in token_files.read_range(spark, path, 0, total).orderBy("first").collect() for x in r.ids][total // 3 : total // 3 + 50]


def test_token_files_of_odd_rows(spark, odd, none, bpe, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "a"), bpe)
    assert token_files.read_documents(spark, str(tmp_path / "a")).count() == odd.count()
    token_files.write_token_files(none, str(tmp_path / "b"), bpe)
    assert token_files.read_documents(spark, str(tmp_path / "b")).count() == 0
    with pytest.raises(ValueError):
        token_files.write_token_files(odd, str(tmp_path / "c"), bpe, unit="nibble")
    with pytest.raises(ValueError):
        token_files.write_token_files(odd, str(tmp_path / "c"), bpe, block=12)


def test_damage_is_found(spark, bpe, tmp_path):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    token_files.write_token_files(docs, str(tmp_path / "t"), bpe)
    chunks = spark.read.parquet(str(tmp_path / "t/chunks")).withColumn("check", F.col("check") + 1)
    chunks.write.parquet(str(tmp_path / "u/chunks"))
    spark.read.parquet(str(tmp_path / "t/index")).write.parquet(str(tmp_path / "u/index"))
    with pytest.raises(Exception, match="damaged"):
        token_files.read_documents(spark, str(tmp_path / "u"))


@pytest.mark.parametrize("length", [2, 3, 5])
def test_runs_back(length):
    rng = np.random.default_rng(length)
    words = rng.integers(0, 2**64, 60, dtype=np.uint64)
    prints, counts = np.unique(words[rng.integers(0, 60, (5000, length))], axis=0, return_counts=True)
    for bits in (0, 2, 5):
        batch = collocations._runs(prints, counts, bits).to_pylist()
        parts = [collocations._unpacked(r["run"], r["n"], length) for r in batch]
        got = np.concatenate([np.vstack([w, c.view(np.uint64)]) for w, c in parts], axis=1).T
        assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, np.column_stack([prints, counts.astype(np.uint64)]).tolist()))
        assert len({r["part"] for r in batch}) == len(batch) <= 1 << bits
        for w, _ in parts:
            assert (np.lexsort(w[::-1]) == np.arange(w.shape[1])).all()
