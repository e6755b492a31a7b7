"""Connected components of links between numbers, as a few joins on each round.

Alternating large-star and small-star steps: each step hangs the neighbours of
a node on the least of them.  The number of rounds grows with the logarithm of
the longest chain.  Each round is written to the shared folder, so the plan
stays short and a lost executor costs one round; nothing is collected.  A node that many
links share meets its least neighbour by common.meet, so it is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = common.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    return common.meet(both, least, ["u"]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "down")
    least = common.written(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    hung = common.meet(down, least, ["u"]).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node that it reaches.

    Links from a node to itself and repeated links are allowed and add nothing.
    """
    now = common.written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = common.written(_small_star(_large_star(now)).where("a <> b").distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(state)
