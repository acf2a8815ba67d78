"""Connected components of an edge list by repeated star contraction, on Spark at every step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecost.llm.scratch import stored

ROUNDS = 60


def _are_stars(pairs: DataFrame) -> bool:
    """If every node has one partner below it at most, and none of these has one itself."""
    ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        pairs.select(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    sums = ends.groupBy("n").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    return sums.where("below > 1 or (below > 0 and above > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node of `edges` (a bigint, b bigint).

    Each round sends every node and its larger neighbours to the smallest node around, then its smaller neighbours.
    Minima are taken by key with partial sums before the shuffle, so a node with very many neighbours is a few rows
    per task; the join that follows splits it by adaptive execution. Rounds grow with the logarithm of the number of
    nodes. Each is written to shared storage, so no lineage builds up.
    """
    pairs = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(ROUNDS):
        if _are_stars(pairs):
            break
        # large star: neighbours above a node go to the smallest of the node and its neighbours
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = stored(small)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
