"""Connected components of a table of links by alternating large-star and small-star rounds (Kiveris et al. 2014).

Every round groups links by node with map-side partial minima and joins the minimum back with an ordinary shuffled join, which
Spark splits where a node is hot; nothing is collected.  Each round is written in the shared folder, so an executor's loss
repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, drop_cut


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in ``links`` (a, b); self-links and repeats are harmless."""
    now = cut(spark, links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        after = cut(spark, _small_star(_large_star(now)))
        drop_cut(spark, now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    stars = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
