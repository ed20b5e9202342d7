"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.shared import delete, written


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Each node u hands the least of itself and its neighbours to its larger (``both``) or smaller neighbours.

    ``links`` holds (a, b) with a > b. The least neighbour is an aggregate that starts in the map tasks. It is
    written before the join, so that both sides are plain shuffles and Spark splits a node with very many
    neighbours: no node's list meets in one task.
    """
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        pairs = pairs.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(
        pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m")), "least"
    )
    joined = pairs.join(least, pairs["u"] == least["k"])
    if both:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()
    out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("k").alias("a"), F.col("m").alias("b"))
    )
    return out.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each linked node can reach; nodes without a link are left out.

    Links may be repeated, point either way, or join a node to itself; null ends are ignored. The number of
    rounds grows with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    now = written(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct(),
        "links",
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        after = written(_star(written(_star(now, True), "large"), False), "small")
        now, before = after, mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct()
    )
