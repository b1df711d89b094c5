"""Fill-in-middle transformation of documents (operator 11) by repeated captures.

One ``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of the
group: the length of its list of ends is the number of units, and both cuts are looked
up in it. Nothing iterates over units. The repetition is possessive, so the matcher
holds no states to go back to; a text of millions of units costs its list of ends.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its line feed, or a last one without.
LINE = r"[^\n]*+\n|[^\n]++"
MARKERS = ("<P>", "<S>", "<M>")
_RESULT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


@cache
def _units(unit: str) -> regex.Pattern:
    return regex.compile(f"({unit})*+")


def unit_ends(text: str, unit: str = LINE) -> list[int]:
    """Where each unit of the text ends, in code points. The units must cover the text."""
    found = _units(unit).fullmatch(text)
    if found is None:
        raise ValueError("the text isn't a sequence of units")
    return found.ends(1)


def transform(text: str, draws: tuple[int, int, int, int], unit: str = LINE, markers: tuple[str, str, str] = MARKERS, percent: int = 100, spm_percent: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and of middle, and the output."""
    ends = unit_ends(text, unit)
    n = len(ends)
    if not text or any(m in text for m in markers) or draws[2] % 100 >= percent:
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = markers
    if draws[3] % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str, markers: tuple[str, str, str] = MARKERS) -> str:
    """The text again, from what was made of it."""
    if form == "plain":
        return output
    first, second = (markers[0], markers[1]) if form == "psm" else (markers[1], markers[0])
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(markers[2])
    return one + middle + two if form == "psm" else two + middle + one


def _draws(doc_id: Column, seed: int) -> Column:
    """The first four groups of eight hex digits of a digest of seed and id, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def fill_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", column: str = "fim", seed: int = 7, unit: str = LINE, markers: tuple[str, str, str] = MARKERS, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``docs`` and a struct column: n, form, prefix_chars, middle_chars, output.

    Rows are handled one by one in the tasks that read them; nothing is shuffled. The
    cuts of a document follow from seed and id alone, so rows that share an id and a text
    get the same output; a null id draws as an empty one. Null and empty texts, and texts
    that hold a marker, stay plain. ``percent`` of the others are transformed,
    ``spm_percent`` of these with the suffix first. Ids are cast to long. A column that
    has the name ``column`` already is an error, so none is lost.
    """
    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {column!r}")
    if len(set(markers)) != 3 or not all(markers) or any(a in b for a in markers for b in markers if a != b):
        raise ValueError("markers must differ and not hold one another")

    @F.arrow_udf(_RESULT)
    def run(texts: pa.Array, draws: pa.Array) -> pa.Array:
        rows = [transform(t.as_py() or "", tuple(d.as_py()), unit, markers, percent, spm_percent) for t, d in zip(texts, draws, strict=True)]
        n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
        arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
        return pa.StructArray.from_arrays(arrays, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.withColumn(column, run(F.col(text), _draws(F.col(doc_id).cast("long"), seed)))


def restored(made: DataFrame, output: Column, form: Column, column: str = "restored", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``made`` and the texts rebuilt from outputs and forms."""

    @F.arrow_udf("string")
    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([None if o.as_py() is None else restore(o.as_py(), f.as_py(), markers) for o, f in zip(outputs, forms, strict=True)], pa.string())

    return made.withColumn(column, run(output, form))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_middle(docs)
    both = restored(made, F.col("fim.output"), F.col("fim.form"))
    digests = [F.sha2(F.col(c), 256).alias(name) for c, name in (("fim.output", "output_sha256"), ("restored", "restored_sha256"))]
    return both.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", *digests)


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}

#: The restored text is taken out of the output again, between its markers.
ORACLES = {
    "op11_fill_in_middle": """
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), lines AS (
    SELECT *, string_split(text, chr(10)) AS parts, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS BIGINT) AS n,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM docs
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS first, greatest(h1 % (n + 1), h2 % (n + 1)) AS second,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM lines
), lengths AS (
    SELECT *, least(length(text), coalesce(length(array_to_string(parts[1:first], chr(10))), 0) + CASE WHEN first > 0 THEN 1 ELSE 0 END) AS a,
        least(length(text), coalesce(length(array_to_string(parts[1:second], chr(10))), 0) + CASE WHEN second > 0 THEN 1 ELSE 0 END) AS b
    FROM cuts
), made AS (
    SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || text[1:a] || '<S>' || text[b + 1:] || '<M>' || text[a + 1:b] ELSE '<S>' || text[b + 1:] || '<P>' || text[1:a] || '<M>' || text[a + 1:b] END AS output
    FROM lengths
), back AS (
    SELECT *, CASE form WHEN 'plain' THEN output
        WHEN 'psm' THEN output[4:strpos(output, '<S>') - 1] || output[strpos(output, '<M>') + 3:] || output[strpos(output, '<S>') + 3:strpos(output, '<M>') - 1]
        ELSE output[strpos(output, '<P>') + 3:strpos(output, '<M>') - 1] || output[strpos(output, '<M>') + 3:] || output[4:strpos(output, '<P>') - 1] END AS again
    FROM made
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
    sha256(output) AS output_sha256, sha256(again) AS restored_sha256
FROM back
""",
}
