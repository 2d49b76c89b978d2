"""Connected components of a table of links, by alternating star contraction.

Each round joins every node's larger neighbours to its smallest one (large star), then
every node and its smaller neighbours to the smallest (small star). The number of
links never grows, and after a few rounds each is (node, smallest node reachable).
Links stay in written tables, of which only the last is kept; the driver sees a count and a
checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatescope.llm.common import discard, shuffles_removed, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    # Links point from the larger node a to the smaller b.
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links between long ids to (id, component_id), for ids that have a link."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    spark, links = links.sparkSession, written(pairs.where("a <> b").distinct(), "links")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = None
    while True:
        with shuffles_removed(spark):
            after = tuple(links.select(mark.alias("m")).first()["m"])
        if after == before or after[0] == 0:
            break
        former, links = links, written(_small_star(_large_star(links)), "links")
        discard(former)
        before = after
    nodes = links.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return nodes.union(links.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()
