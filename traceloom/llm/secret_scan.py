"""Secret scan (operator 3): keyword automaton, anchored expressions near its hits, checksums.

One Aho-Corasick automaton finds all keywords in a pass over the text. Only at a hit is
an expression tried, anchored there. Kinds whose tokens embed a checksum are kept only
if it holds. Runs of hex digits have no keyword; every 32nd character is probed, as a
run of 32 can't pass between two probes, and only around a probe that is a hex digit is
the run measured.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which kinds that start at the same place are listed.
BASE_KINDS = ("assign", "access", "hex")
MORE_KINDS = ("forge", "package", "jwt")
SPANS = "array<struct<kind:string,start:int,stop:int>>"
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_FORGE = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_PACKAGE = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{16,})")
_KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "package": ("npm_",), "jwt": ("eyj",)}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_DIGITS = frozenset("0123456789abcdef")
_FOLD = {c: c + 32 for c in range(65, 91)}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum_holds(body: str, check: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of those before."""
    value = zlib.crc32(body.encode())
    digits = ""
    for _ in range(6):
        value, k = divmod(value, 62)
        digits = _DIGITS[k] + digits
    return digits == check


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def _hex_runs(text: str, least: int = 32):
    """Maximal runs of hex digits of at least that length."""
    done = 0
    for at in range(least - 1, len(text), least):
        if at < done or text[at] not in _HEX_DIGITS:
            continue
        start = at
        while start > done and text[start - 1] in _HEX_DIGITS:
            start -= 1
        done = _HEX.match(text, at).end()
        if done - start >= least:
            yield start, done


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind. A null or empty text has none.

    The base kinds are matched leftmost and without overlap within a kind, and a match
    that fails its length still takes up its characters.
    """
    if not text:
        return []
    folded = text.lower()
    if len(folded) != len(text):  # a letter whose lower case is longer
        folded = text.translate(_FOLD)
    found: list[tuple[str, int, int]] = []
    until = dict.fromkeys(_KEYWORDS, 0)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _automaton().iter(folded))
    for at, kind in hits:
        if at < until[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(text, at)
            good = m and len(m[2]) >= 8
        elif kind == "access":
            m = _ACCESS.match(text, at)
            good = m and m.end() - at >= 16
        elif kind == "jwt":
            m = _JWT.match(text, at)
            good = m and _json_part(m[1]) and _json_part(m[2])
        else:
            m = (_FORGE if kind == "forge" else _PACKAGE).match(text, at)
            good = m and checksum_holds(m[1], m[2])
        if m:
            until[kind] = m.end()
            if good:
                found.append((kind, at, m.end()))
    found += [("hex", a, b) for a, b in _hex_runs(text)]
    order = BASE_KINDS + MORE_KINDS
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def scan(docs: DataFrame, text: str = "text", column: str = "secrets") -> DataFrame:
    """``docs`` and an array column of spans. Rows are handled one by one, so no order or key matters.

    A column that has the name ``column`` already is an error, so none is lost.
    """
    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {column!r}")

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        return pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in spans(t.as_py())] for t in texts], type=kind)

    return docs.withColumn(column, run(F.col(text)))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; overlapping spans become one."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for content in texts:
            content = content.as_py()
            found = spans(content)
            if found:
                parts, at = [], 0
                for _, a, b in found:
                    if a >= at:
                        parts += [content[at:a], mask]
                    at = max(at, b)
                content = "".join([*parts, content[at:]])
            out.append(content)
        return pa.array(out, pa.string())

    return docs.withColumn(text, run(F.col(text)))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda spans_: F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE_KINDS))
    of_kind = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return docs.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES: dict[str, str] = {}
