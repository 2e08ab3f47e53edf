"""What the operators share: table access, lineage cuts, small Column idioms."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.lineage import save, shared_dir, written  # noqa: F401

#: Characters that separate words for size and shingle purposes: ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_saved(*frames: DataFrame) -> None:
    """Remove tables that ``save`` wrote, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/quire/" in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of ``written()`` that nothing reads any more; those gone already don't matter."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        written().remove(name)


def sample_texts(texts: DataFrame, key: str, most: int, most_bytes: int) -> DataFrame:
    """(key, text): of the different texts of each key those of the smallest hashes, at most ``most`` and ``most_bytes`` of them.

    Whole texts; those longer than a fortieth of ``most_bytes`` are left out. Keys, hashes and sizes are chosen first, from about
    four times as many rows as are wanted of each key, then the texts are fetched: none is sorted or sent anywhere before."""
    rows = texts.where(F.col(key).isNotNull() & (F.octet_length("text") <= most_bytes // 40)).select(key, "text", F.xxhash64("text").alias("h"))
    slim = save(rows.groupBy(key, "h").agg(F.min(F.octet_length("text")).alias("size")), "sample-hashes")
    share = save(slim.groupBy(key).agg((4.0 * most / F.count(F.lit(1))).alias("share")), "sample-shares")
    # so few keys are broadcast that the filter runs before any row is dealt out by key
    near = slim.join(F.broadcast(share) if share.count() <= 10_000 else share, key).where(F.col("h") / 2.0**64 + 0.5 <= F.col("share"))
    ahead = Window.partitionBy(key).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    best = near.withColumns({"r": F.count(F.lit(1)).over(ahead), "b": F.sum("size").over(ahead)}).where((F.col("r") <= most) & (F.col("b") <= most_bytes))
    best = save(best.select(key, "h"), "sample")
    small = F.broadcast(best) if best.count() <= 200_000 else best
    return rows.join(small, [key, "h"]).groupBy(key, "h").agg(F.min("text").alias("text")).select(key, "text")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once per row: a lambda variable is never inlined and recomputed by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its letter case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no frame needs any more: they go when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
