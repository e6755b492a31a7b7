"""Tables stored by entity (R7 to R9, R15, S10): bucketed by a key and sorted inside, so that work by that key needs no shuffle.

A table is written once, one file for each bucket.  Windows, aggregations and
as-of joins by the key then run on the buckets as they lie, and two tables with
the same number of buckets are joined bucket by bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import shared

#: Bytes that a bucket should have, about.
BUCKET_BYTES = 256 << 20


def buckets_for(bytes_: int, *, least: int = 8) -> int:
    """A power of two, so that tables of different sizes can still be joined bucket by bucket (one bucket of the one meets several of the other)."""
    n = least
    while n * BUCKET_BYTES < bytes_:
        n *= 2
    return n


def store(df: DataFrame, keys: Sequence[str], sort: Sequence[str] = (), *, buckets: int = 8, name: str | None = None, path: str | None = None) -> str:
    """Write df bucketed by keys and sorted by keys and sort; the name of the table.

    Rows are dealt by the same hash as buckets, so a bucket is one file.  Null
    keys are a key.  path is by default a fresh folder of the shared one; name
    must not be taken.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = path or shared.fresh_folder(spark, name)
    rows = df.repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *sort).option("path", path).saveAsTable(name)
    return name


def attach(spark: SparkSession, name: str, path: str, schema: T.StructType, keys: Sequence[str], sort: Sequence[str] = (), *, buckets: int = 8) -> DataFrame:
    """Name again what store() wrote to a path, for a session that doesn't know it, and read it."""
    quoted = lambda cs: ", ".join(f"`{c}`" for c in cs)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY ({quoted(keys)}) SORTED BY ({quoted([*keys, *sort])}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
