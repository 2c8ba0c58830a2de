"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators.intermediate import materialise, release


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b); root is the least node of its component.

    The number of rounds grows with the logarithm of the longest chain; each
    round's edges are written down, so plans stay small and a lost executor
    costs one round.  A round's files go when the next one's are there.
    """
    pairs = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    mark = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour is tied to the least of the node and its neighbours
        # written down, so that both sides of the join are plain exchanges and a hub's edges can be split
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node and every smaller neighbour are tied to the least neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u <> v").distinct(), name)
        release(pairs, least)
        pairs = after
        before, mark = mark, pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == mark:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
