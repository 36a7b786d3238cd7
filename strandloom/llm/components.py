"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (the least node reachable) of links(a, b), for every node that has a link to another.

    Every round joins links with the least neighbour of a node; lineage ends at a checkpoint. The rounds needed grow with the
    logarithm of the longest chain. Raises RuntimeError if `rounds` don't suffice."""
    high_low = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpoint(high_low(links))
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = high_low(both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n"))
        edges = checkpoint(high_low(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))))
        new = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).head())
        if new == state:
            break
        state = new
        if new[0] == new[2]:  # every node has one link; done if none of their ends has one of its own
            if edges.join(edges.select(F.col("a").alias("n")), F.col("b") == F.col("n"), "left_semi").isEmpty():
                break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
