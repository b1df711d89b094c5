"""Archives, packing and the pipeline."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import packing, registry, warc
from traceloom.llm.scratch import Scratch


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_op4_equals_sql(spark, duck, data):
    df = registry.QUERIES["op4_warc"](spark, data)
    want = duck.sql(registry.ORACLES["op4_warc"])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in order) for r in want.fetchall())


def test_archives_hold_any_payload(spark, tmp_path):
    random.seed(1)
    html = {1: "x" * 99, 2: "x" * 99, 3: "é\r\n\r\nWARC/1.1\r\n" * 50, 4: "é\r\n\r\nWARC/1.1\r\n" * 50, 5: None, 6: "", 7: "".join(random.choices("abc\r\n", k=5000)), 8: "a" * 3000, 9: "a" * 3000}
    pages = spark.createDataFrame([(k, f"http://a/{k} b\r\nX: y", h, "x") for k, h in html.items()], "page_id long, url string, html string, digest string")
    chunks = warc.record_chunks(pages, chunk_bytes=700)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 700
    warc.write_archives(chunks, str(tmp_path / "w"), records_per_file=3)
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert set(got) == set(html)
    for k, h in html.items():
        raw = (h or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].intact) == (len(raw), hashlib.sha256(raw).hexdigest(), True)
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {4: ("revisit", 3), 9: ("revisit", 8)}
    assert got[7].n_chunks > 5


def test_archives_of_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, None, "y" * 200), (3, None, "y" * 200), (3, "u", "y" * 200), (None, "u", "z" * 200), (None, "u", "z" * 200)], "page_id long, url string, html string")
    warc.write_archives(warc.record_chunks(rows), str(tmp_path / "w"))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == [(0, "response", 0), (0, "response", 0), (0, "revisit", 3), (3, "response", 0), (3, "response", 0)]
    warc.write_archives(warc.record_chunks(rows.where("false")), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def record(kind, body, **more):
    lines = [b"WARC/1.0", f"WARC-Type: {kind}".encode(), b"WARC-Date: 2020-01-01T00:00:00Z", *(f"{k.replace('_', '-')}: {v}".encode() for k, v in more.items()), f"Content-Length: {len(body)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def foreign(n=5):
    """Records as other tools write them: several kinds, HTTP headers, SHA-1 digests, no headers of ours."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    out = [record("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:uuid:i>")]
    for k in range(n):
        body = bytes(range(256)) * k + b"\r\n\r\nWARC/1.0\n" * k
        out.append(record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID=f"<urn:uuid:q{k}>"))
        out.append(record("response", http + body, WARC_Record_ID=f"<urn:uuid:r{k}>", WARC_Target_URI=f"http://a/{k}", Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:ABC"))
    return out, {f"urn:uuid:r{k}": hashlib.sha256(bytes(range(256)) * k + b"\r\n\r\nWARC/1.0\n" * k).hexdigest() for k in range(n)}


@pytest.mark.parametrize("how", ["members", "one member", "plain"])
def test_archives_of_others(spark, tmp_path, how):
    import gzip

    records, want = foreign()
    content = b"".join(gzip.compress(r) for r in records) if how == "members" else gzip.compress(b"".join(records)) if how == "one member" else b"".join(records)
    for name in "ab":
        (tmp_path / f"{name}.warc{'' if how == 'plain' else '.gz'}").write_bytes(content)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert len(got) == 2 * len(want)
    assert {r.record_id: r.payload_digest for r in got} == want
    assert {(r.page_id, r.intact, r.record_type) for r in got} == {(None, None, "response")}


def test_cut_and_broken_archives_are_errors(spark, tmp_path):
    import gzip

    records, _ = foreign()
    for name, content in {"cut": gzip.compress(b"".join(records))[:-40], "within": gzip.compress(b"".join(records)[:-30]), "trailing": gzip.compress(b"".join(records) + b"garbage\r\n\r\n")}.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.warc.gz").write_bytes(content)
        with pytest.raises(Exception, match="within a record|not a WARC record|Unexpected end|EOF"):
            warc.read_archives(spark, str(folder)).collect()
    pages = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string")
    chunks = warc.record_chunks(pages, chunk_bytes=1000)
    for missing in (0, 2, 4):
        warc.write_archives(chunks.where(f"chunk <> {missing}"), str(tmp_path / f"m{missing}"))
        with pytest.raises(Exception, match="missing"):
            warc.read_archives(spark, str(tmp_path / f"m{missing}")).collect()


def test_a_payload_of_300_mb_is_read_in_pieces():
    """Alone and as a segment: what is held at once stays below 16 MB."""
    import tracemalloc

    block, want = b"0123456789abcdef" * (1 << 16), hashlib.sha256()
    for _ in range(300):
        want.update(block)
    for more in ({}, {"WARC_Segment_Number": 1, "WARC_Segment_Total_Length": 300 << 20}):
        head = record("resource", b"", WARC_Record_ID="<urn:uuid:x>", **more).replace(b"Content-Length: 0", f"Content-Length: {300 << 20}".encode())[:-4]
        reader, digest, rows = warc.ArchiveReader(), hashlib.sha256(), 0
        tracemalloc.start()
        for piece in (head, *(block for _ in range(300)), b"\r\n\r\n"):
            for row in reader.feed(piece):
                rows += 1
                digest.update(row[-1] or b"")
                found = row[-2]
        reader.close()
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
        tracemalloc.stop()
        assert (found if not more else digest.hexdigest()) == want.hexdigest()
        assert rows == (300 if more else 1)


def test_records_name_what_they_revisit(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", "y" * 300) for k in (4, 2, 9)], "page_id long, url string, html string")
    warc.write_archives(warc.record_chunks(pages), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got[2].record_type == "response"
    assert {got[k].refers_to_record for k in (4, 9)} == {got[2].record_id}
    assert len({r.record_id for r in got.values()}) == 3


def check_bins(rows, most):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return len(bins)


def test_plan_fills_bins_tightly():
    rng = np.random.default_rng(0)
    for most in (10, 64, 200):
        lengths = rng.integers(1, most + 1, 3000)
        counts = np.bincount(lengths, minlength=most + 1)
        plan = packing.plan_bins(counts, most)
        used = np.zeros(most + 1, dtype=int)
        for bin_, times in plan:
            assert sum(bin_) <= most
            for x in bin_:
                used[x] += times
        assert (used == counts).all()
        assert len(plan) <= 8 * most


def test_smallest_is_replaced_by_two_that_fit_better():
    counts = np.zeros(11, dtype=int)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert packing.plan_bins(counts, 10)[0] == ((6, 2, 2), 1)


def test_op7_equals_whole_text_encoding(spark, data, texts, path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    got = packing.op7_best_fit_packing(spark, data).collect()
    want = {}
    for k, t in texts.items():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            piece = np.array(ids[at : at + 2048], dtype="<u4")
            want[k, n] = (at, len(piece), zlib.crc32(piece.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    total = sum(v[1] for v in want.values())
    assert check_bins(got, 2048) <= -(-total // 2048) * 1.01 + 1


def test_words_encode_as_in_the_text(path):
    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(path), packing.WordTokenizer(path, most=20)
    random.seed(2)
    parts = ["Hello", "it's", " ", "  ", "\n", " ", " ", "\x1c", "é", "́", "ΣΑΣ", "İx", "<|endoftext|>", "<|startoftext|>a", "123", "don't!!", "日本", "\x0b", "\u0085", "'ll", "word.", "Word,", "É!", "<|ENDOFTEXT|>", "a.b.", "x%$", "é.", "!!", "5."]
    for _ in range(800):
        text = "".join(random.choices(parts, k=random.randrange(10)))
        assert words.encode([text.encode()])[0].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_fingerprints_that_collide_change_nothing(path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends, seed=0: (starts * 0 + 7).astype(np.uint64))
    plain, words = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for text in ("alpha beta gamma alpha, beta!", "delta beta ... " + "." * 50 + " x" + "!" * 40):
        assert words.encode([text.encode()], 0)[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


def test_very_long_text_is_cut_into_pieces(spark, path):
    from tokenizers import Tokenizer

    text = "word " * 40_000 + "é" * 5000 + "." * 3000 + " 7" * 3000
    ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0]
    rows = packing.tokenized_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).orderBy("piece").collect()
    assert [len(r.ids) // 4 for r in rows] == [min(2048, len(ids) - at) for at in range(0, len(ids), 2048)]
    assert np.frombuffer(b"".join(r.ids for r in rows), dtype="<u4").tolist() == ids


def test_packing_of_odd_rows(spark, odd, none, path):
    pieces = packing.tokenized_pieces(odd, path, most=16)
    got = packing.pack(Scratch(spark).save(pieces, "p"), 16)
    assert got.where("piece = 0").count() == odd.count()
    assert "ids" in got.columns
    check_bins(got.collect(), 16)
    assert packing.pack(packing.tokenized_pieces(none, path), 2048).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    scratch, kept, out = Scratch(spark), [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.save(stage(spark, out, data), name)
        assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
    assert kept[0] > kept[1] >= kept[2] == kept[3]
    assert 0.5 * docs.count() < len(kept[2])
    packed = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in packed} == kept[3]
    check_bins(packed, 2048)


def test_pipeline_stages_take_odd_rows(spark, odd, none, data):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, data).count() == 0
        out = stage(spark, odd, data)
        assert out.columns == odd.columns
        assert out.count() == {"quality_rules": 0, "ngram_jaccard_join": 6}.get(name, odd.count()), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, data).count() == odd.count()


def near_groups(texts, n=5, percent=80):
    """Smallest id of the group of each text with words, comparing all pairs."""
    sets = {}
    for k, t in texts.items():
        words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[k] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    label = {k: k for k in sets}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            label[high] = low
    return {k for k in sets if not sets[k] or top(k) == k}


def test_pipeline_by_hand(spark, duck, data, path):
    """Every stage against a plain version, each on what the one before kept."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from traceloom.llm import decontamination, quality_rules, secret_scan
    from traceloom.llm.hashing import letter_words

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    verdicts = duck.sql(quality_rules._ORACLE)
    at = [verdicts.columns.index(c) for c in ("doc_id", "kept")]
    left = {k: texts[k] for k, kept in ([r[x] for x in at] for r in verdicts.fetchall()) if kept}
    left = {k: left[k] for k in near_groups(left)}
    words = lambda text: letter_words([(text or "").encode()])[0]
    items = [w for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len(w := words(r.text))]
    left = {k: t for k, t in left.items() if not any(decontamination.align(i, words(t))[0] >= 0.6 for i in items)}
    for k, t in left.items():
        spans = secret_scan.spans(t)
        gone = bytearray(len(t or ""))
        for _, a, b in spans:
            gone[a:b] = b"\x01" * (b - a)
        cut, inside = [], False
        for c, bad in zip(t or "", gone, strict=True):
            cut += [] if bad and inside else ["[SECRET]"] if bad else [c]
            inside = bool(bad)
        merged = any(a2 == b1 for (_, _, b1), (_, a2, _) in itertools.pairwise(spans))
        left[k] = corpus_pipeline.secret_scan.redact(spark.createDataFrame([(t,)], "text string")).first().text if merged else "".join(cut) if spans else t
    library = Tokenizer.from_file(path)
    want = {}
    for k, t in left.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            want[k, n] = (start, len(ids[start : start + 2048]), zlib.crc32(np.array(ids[start : start + 2048], dtype="<u4")))
    packed = corpus_pipeline.run(spark, data).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == want and len(packed) == len(want)
    check_bins(packed, 2048)


def test_many_rows_of_one_id_and_text(spark, data):
    """No key of the second stage is one task's: null ids without words stay all, of other repeated rows one does."""
    import corpus_pipeline

    rows = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(" ")).otherwise(F.lit("one two three four five six")).alias("text"), F.col("id").cast("string").alias("source"))
    out = corpus_pipeline.drop_near_copies(spark, rows, data)
    assert out.columns == rows.columns
    assert {r.text: (r.n, r.least) for r in out.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("least")).collect()} == {" ": (30_000, "0"), "one two three four five six": (1, "1")}
