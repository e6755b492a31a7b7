"""Tables that are written once and read again: in the folder that driver and executors share.

A step that is used twice, or that must not come out differently when an
executor is lost, is written here instead of being kept in memory.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast at most.
SMALL = 100_000

_made: list[str] = []
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir of the session; only where that is unset and all runs on one machine, one under the warehouse, taken away at the end."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if house not in _own:
            _own[house] = f"{house}/_shared-{uuid.uuid4().hex}"
            if urlparse(house).scheme in ("", "file"):
                atexit.register(shutil.rmtree, urlparse(_own[house]).path, ignore_errors=True)
        place = _own[house]
    return place.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new name inside the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_leave, spark)
    _made.append(path)
    return path


def _leave(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        remove_written(spark)


def remove_written(spark: SparkSession, since: int = 0) -> int:
    """Delete what this program has written (but for its first since folders), once no result that reads it is needed; how many folders."""
    n = 0
    while len(_made) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; otherwise the join is Spark's choice.  df should be a written table, as it is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
