"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalforge.llm.common import stored

#: Rounds at most; each shortens the longest chain by about half.
ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node of its component.

    Nothing is gathered in one place: a node's edges meet in an aggregate of its least
    neighbour and in a join that adaptive execution may split.
    """
    pairs = edges.filter(F.col("u") != F.col("v"))
    now = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(ROUNDS):
        # large star: every larger neighbour of u is linked to u's least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter(F.col("u") != F.col("v")).distinct())
        # small star: every smaller neighbour of u, and u, are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = stored(moved.filter(F.col("u") != F.col("v")).distinct())
        if _same(now, after):
            break
        now = after
    else:
        raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _same(a: DataFrame, b: DataFrame) -> bool:
    def sums(x: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(x.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())

    return sums(a) == sums(b)
