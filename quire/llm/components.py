"""Connected components as alternating stars: every round is two joins with a minimum, no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_saved, save


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hops = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hops.where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) to (node, root): the smallest node that each node reaches.

    Nodes without an edge to another node are absent. Loops, repeated and reversed
    edges are fine; rows with a null end are ignored. The number of rounds grows with the
    logarithm of the longest path; what a round writes is dropped after the next.
    """
    now = save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        new = save(_small_star(_large_star(now)), "stars")
        drop_saved(now)
        now = new
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
