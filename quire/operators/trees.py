"""Trees and chains of parent links, followed by joins: no bound on rows, and lineage is cut where levels add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.lineage import save, written


def descend(nodes: DataFrame, key: str, parent: str, root: Column, inherited: list[str]) -> DataFrame:
    """(key, inherited, depth): nodes that are reached from those of which ``root`` holds, level by level. What a node leaves NULL
    in ``inherited`` comes from its nearest ancestor. Each level is a table, and joined once with the nodes."""
    nodes = save(nodes.select(key, parent, *inherited), "tree-nodes")
    spark, mark = nodes.sparkSession, len(written())
    level = save(nodes.where(root).select(key, *inherited, F.lit(0).cast("long").alias("depth")), "tree-level")
    while not level.isEmpty():
        above = level.select(F.col(key).alias("_up"), *[F.col(c).alias(f"_{c}") for c in inherited], F.col("depth").alias("_depth"))
        below = nodes.join(above, F.col(parent) == F.col("_up"))
        level = save(below.select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in inherited], (F.col("_depth") + 1).alias("depth")), "tree-level")
    return spark.read.schema(level.schema).parquet(*written()[mark:])


def follow(links: DataFrame, key: str, target: str, hops: int) -> DataFrame:
    """(key, target, hops): each chain of links to where it ends, or as far as ``hops`` links. Where links of one key part, the longest chains count."""
    step = links.select(F.col(key).alias("_from"), F.col(target).alias("_to"))
    chain = links.select(key, target, F.lit(1).alias("hops"))
    for _ in range(hops - 1):
        on = F.col("_from").isNotNull()
        chain = chain.join(step, F.col(target) == F.col("_from"), "left").select(key, F.when(on, F.col("_to")).otherwise(F.col(target)).alias(target), (F.col("hops") + on.cast("int")).alias("hops"))
    return chain.withColumn("_most", F.max("hops").over(Window.partitionBy(key))).where("hops = _most").drop("_most")
