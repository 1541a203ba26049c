"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; links shrink towards stars round their smallest node,
in a number of rounds that grows with the logarithm of the longest path. A count of each node's ends tells
when only stars are left, so no round is spent on finding that nothing changes. Every round is settled
in the shared folder, so its lineage stays short, and the round before is removed. A node of very many links is
dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, settled


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(links.select(F.col("dst").alias("u"), F.col("src").alias("v")))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node beside it."""
    both = _both_ways(links)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return hot_join(both.filter("v > u"), least, ["u"], "n", 2 * total).select(F.col("m").alias("src"), F.col("v").alias("dst")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    near = hot_join(down, least, ["u"], "n", total).filter("v <> m").select(F.col("m").alias("src"), F.col("v").alias("dst"))
    return near.unionByName(least.select(F.col("m").alias("src"), F.col("u").alias("dst"))).distinct()


def _shape(links: DataFrame) -> tuple[int, bool]:
    """The number of links, and whether they are stars: each node is the larger end of at most one link, and then the smaller end of none."""
    ends = links.select(F.col("src").alias("node"), F.lit(0).alias("larger")).unionByName(links.select(F.col("dst").alias("node"), F.lit(1).alias("larger")))
    nodes = ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.count("*").alias("n"))
    found = nodes.agg(F.sum("larger").alias("links"), F.count_if((F.col("larger") > 0) & (F.col("n") > 1)).alias("others")).first()
    return found.links or 0, not found.others


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component.

    links: src, dst; loops and repeated links are allowed. Raises if they are no stars after
    ``max_rounds`` rounds, as a partial answer would be wrong.
    """
    now = settled(links.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    for left in range(max_rounds, -1, -1):
        n, stars = _shape(now)
        if stars:
            break
        if not left:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        wide = settled(_large_star(now, n))
        discard(now)
        now = settled(_small_star(wide, wide.count()))
        discard(wide)
    return now.select(F.col("dst").alias("node"), F.col("src").alias("root")).unionByName(now.select(F.col("src").alias("node"), F.col("src").alias("root")).distinct())
