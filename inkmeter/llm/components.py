"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import kept


def _undirected(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest node around it."""
    around = _undirected(links)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = around.where(F.col("b") > F.col("a")).join(least, "a")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them; links here point downwards (a > b)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    out = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); the root is the component's smallest node.

    Every round halves distances to the root, so the number of rounds grows with the logarithm of the longest
    chain.  Each round's links are written to the shared scratch folder.  A star is left when a round changes
    nothing, which is seen by comparing an order-free checksum of the links.
    """
    def state(df: DataFrame):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = kept(links, "links")
    before = state(links)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        links = kept(_small_star(_large_star(links)), "links")
        after = state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
