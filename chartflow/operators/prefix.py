"""Flags for codes that begin with one of many prefixes, hierarchies among flags, weighted sums.

Prefixes are an index: a table of prefixes with a bit for each condition that
has them.  A code's own prefixes, one for each length that occurs, are looked up
in it, so a row costs a lookup for each length and no pattern is tried.  The
bits of a key are united by one aggregation, and become columns at the end.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Conditions that share a number.
WIDTH = 62


def starts_with_any(code: Column, prefixes: list[str]) -> Column:
    """Whether a clean code begins with any prefix: one anchored pattern, no join."""
    return F.coalesce(code.rlike("^(?:" + "|".join(re.escape(p.lower()) for p in prefixes) + ")"), F.lit(False))


def prefix_index(conditions: dict[str, list[str]]) -> dict[int, dict[str, list[int]]]:
    """For each length of a prefix: the prefixes, with the bits of their conditions in one number for each WIDTH conditions."""
    words = -(-len(conditions) // WIDTH)
    out: dict[int, dict[str, list[int]]] = {}
    for i, prefixes in enumerate(conditions.values()):
        for p in prefixes:
            out.setdefault(len(p), {}).setdefault(p.lower(), [0] * words)[i // WIDTH] |= 1 << i % WIDTH
    return out


def with_bits(df: DataFrame, code: Column, conditions: dict[str, list[str]], name: str = "__bits") -> DataFrame:
    """df with a column name0, name1, ... for each WIDTH conditions: the bits of those that the code belongs to.

    The index is a list in the program, a few hundred entries, so it is broadcast, by length.
    """
    words = range(-(-len(conditions) // WIDTH))
    rows, parts = df.withColumn("__code", code), []
    for length, entries in sorted(prefix_index(conditions).items()):
        found = [f"__l{length}w{w}" for w in words]
        index = df.sparkSession.createDataFrame([(p, *bits) for p, bits in entries.items()], ", ".join(["__prefix string", *(f"{f} long" for f in found)]))
        rows = rows.join(F.broadcast(index), F.substring("__code", 1, length) == F.col("__prefix"), "left").drop("__prefix")
        parts.append(found)
    bits = {f"{name}{w}": reduce(Column.bitwiseOR, (F.coalesce(f[w], F.lit(0)) for f in parts), F.lit(0).cast("long")) for w in words}
    return rows.withColumns(bits).drop("__code", *(c for f in parts for c in f))


def flags(df: DataFrame, keys: list[str], code: Column, conditions: dict[str, list[str]], hierarchies: list[tuple[str, str]] = ()) -> DataFrame:
    """A 0/1 column for each condition; of a pair (severe, mild) the mild one is 0 where the severe one is 1.

    A key whose codes are null or belong to nothing has zeros.
    """
    words = [f"__bits{w}" for w in range(-(-len(conditions) // WIDTH))]
    united = with_bits(df, code, conditions).groupBy(*keys).agg(*(F.bit_or(w).alias(w) for w in words))
    one = {c: F.getbit(F.col(f"__bits{i // WIDTH}"), F.lit(i % WIDTH)).cast("int") for i, c in enumerate(conditions)}
    out = united.select(*keys, *(c.alias(n) for n, c in one.items()))
    for severe, mild in hierarchies:
        out = out.withColumn(mild, F.when(F.col(severe) == 1, 0).otherwise(F.col(mild)))
    return out


def weighted_sum(weights: dict[str, int]) -> Column:
    total = F.lit(0)
    for c, w in weights.items():
        total = total + F.col(c) * w
    return total
