"""Connected components of a graph whose edges and nodes only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labourmill.llm.shared import discard, materialize


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component from (a, b): each node of an edge with the least node that it reaches.

    Alternates large-star (a node's larger neighbours go to its least) and small-star (its
    smaller neighbours and itself do), which keeps the number of edges from growing; the number
    of rounds grows with the logarithm of the longest path. Each round's edges are written to the
    shared folder, and those of the round before deleted. A node that very many edges meet is summed by groupBy before it is shuffled,
    and its edges are dealt by both ends when they are made distinct.
    """
    now = materialize(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        # Large-star: u -> least of its neighbours and itself, for neighbours above u.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small-star: every edge (a, b) has a > b; a and its smaller neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        # Stars only: no node is both an end and a centre, and every end has one centre.
        ends = new.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        open_ = ends.filter("n > 1").select("a").unionByName(new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi")).limit(1)
        discard(now)
        now = new
        if not open_.take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
