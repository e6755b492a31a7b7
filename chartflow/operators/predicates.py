"""Filters by ids and samples of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_entities(df: DataFrame, ids: DataFrame | list, key: str) -> DataFrame:
    """Rows of the given entities: a short list goes to the scan, a table is a semi join (P10)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    return df.where(F.col(key).isin(list(ids)))


def sample_entities(df: DataFrame, key: str, n: int = 20, seed: int = 0) -> DataFrame:
    """At most n entities, the same on every run for a seed."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns has a value."""
    return df.where(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull())
