"""The Spark session that the operators expect: UTC, ANSI, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "chartflow", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; more are further settings, with _ for dots."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
