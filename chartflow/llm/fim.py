"""Fill-in-middle transformation (operator 11).

Each text is decoded to an array of its code points (UTF-32).  Code points are
put in classes, the classes of neighbours are compared, and ``flatnonzero`` of
that gives the ends of all units (lines, words with the space after them, or
single code points).  Two of these ends, whose ranks come from a hash of the
document's id, cut the text in prefix, middle and suffix, which are encoded
again and put together with sentinels:

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text, if it is empty, holds a sentinel, or isn't among those that are drawn

It is a map over partitions: no shuffle, and nothing depends on other rows.
``restore`` rebuilds the text from output and form alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

OTHER, SPACE, FEED = 0, 1, 2
#: Which classes to the left and right of a place make it the end of a unit.
UNITS = {
    "line": np.array([[c == FEED for _ in range(3)] for c in range(3)]),
    "word": np.array([[c != OTHER and d == OTHER for d in range(3)] for c in range(3)]),
    "char": np.ones((3, 3), dtype=bool),
}


@dataclass(frozen=True)
class Rule:
    """What is drawn: rate and spm are percentages, of all documents and of those that are cut."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "line"
    seed: int = 7
    rate: int = 100
    spm: int = 50

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or self.unit not in UNITS:
            raise ValueError("sentinels must not be empty, and the unit must be one of " + ", ".join(UNITS))
        # Between text and sentinel no further sentinel may arise, or the output could not be taken apart.
        for x, y in product(marks, repeat=2):
            if any(y.endswith(x[:k]) for k in range(1, min(len(x), len(y)))) or (x is not y and x in y):
                raise ValueError(f"sentinels overlap: {x} and {y}")

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers of 32 bits from the hash of seed and id; a null id is the empty string."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def unit_ends(points: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where the units of a text end, from its code points."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    classes = np.zeros(len(points), dtype=np.uint8)
    classes[(points == 32) | ((points >= 9) & (points <= 13))] = SPACE
    classes[points == 10] = FEED
    inner = np.flatnonzero(UNITS[unit][classes[:-1], classes[1:]]) + 1
    return np.append(inner, len(points))


def cut(text: str, doc_id: int | None, rule: Rule = Rule()) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = unit_ends(points, rule.unit)
    n = len(ends)
    h1, h2, h3, h4 = rule.draws(doc_id)
    if not text or any(mark in text for mark in (rule.prefix, rule.suffix, rule.middle)) or h3 % 100 >= rule.rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(points))))
    if h4 % 100 < rule.spm:
        return n, "spm", a, b - a, f"{rule.suffix}{suffix}{rule.prefix}{prefix}{rule.middle}{middle}"
    return n, "psm", a, b - a, f"{rule.prefix}{prefix}{rule.suffix}{suffix}{rule.middle}{middle}"


def transform(docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output.

    A null text is empty, and an empty text is plain.  A null id draws as the
    empty string.  Repeated rows come out as often as they come in, all alike.
    An empty table gives an empty table.  Other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    more = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(name, kind) for name, kind in more)])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            rows = [cut(t or "", i, rule) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *(name for name, _ in more)])

    return source.mapInArrow(run, schema)


def restore(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that output was made of; null if output is not of that form."""
    marks = {"p": rule.prefix, "s": rule.suffix, "m": rule.middle}

    def parts(order: str) -> Column:
        """prefix, middle, suffix of an output whose sentinels come in this order."""
        pieces = F.split(output, "|".join(re.escape(m) for m in marks.values()), -1)
        at = {k: F.get(pieces, F.lit(i + 1)) for i, k in enumerate(order)}
        whole = F.concat(*(x for k in order for x in (F.lit(marks[k]), at[k])))
        return F.when((F.size(pieces) == 4) & (whole == output), F.concat(at["p"], at["m"], at["s"]))

    return F.when(form == "plain", output).when(form == "psm", parts("psm")).when(form == "spm", parts("spm"))


def digest(cuts: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """transform()'s rows with the SHA-256 of output and of the text that is rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cuts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"), rule)).alias("restored_sha256"))


def sql(documents: str = "documents") -> str:
    """What digest(transform()) gives under the default rule, for DuckDB."""
    part = lambda a, b: f"coalesce(array_to_string(units[{a}:{b}], ''), '')"
    number = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    return f"""
    WITH base AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {documents}),
    cut AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units FROM base),
    drawn AS (
        SELECT *, len(units) AS n, {number(0)} % (len(units) + 1) AS x, {number(1)} % (len(units) + 1) AS y,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {number(2)} % 100 >= 100 THEN 'plain'
                WHEN {number(3)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM cut),
    parts AS (
        SELECT *, {part("1", "least(x, y)")} AS p, {part("least(x, y) + 1", "greatest(x, y)")} AS m, {part("greatest(x, y) + 1", "n")} AS s FROM drawn)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
        CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM parts"""
