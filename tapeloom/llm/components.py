"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import drop_stash, stash


def _star(edges: DataFrame) -> DataFrame:
    """Least neighbour of every node that has a smaller one: groupBy, so a hub is pre-aggregated."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, *, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node of its component.

    Each round is written to the shared folder and the one before deleted. The rounds end when the links stay the
    same, after about log(longest path) of them.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _star(both).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of a node is linked to the least node around it.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours are linked to the least of them.
        low = _star(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        fresh = stash(small, "links")
        now = tuple(fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_stash(edges)
        edges = fresh
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
