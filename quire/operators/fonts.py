"""Font lookups: widths, encodings, text of codes, used codes, subset tags and checksums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.graphics import HELVETICA


def helvetica(spark: SparkSession) -> DataFrame:
    """(code, width): a dimension of 95 rows."""
    return spark.createDataFrame([(c + 32, float(w)) for c, w in enumerate(HELVETICA)], "code int, width double")


def advance(width: Column, size: Column, code: Column, tc: float = 0.0, tw: float = 0.0, scale: float = 1.0) -> Column:
    return (width / 1000 * size + tc) * scale + F.when(code == 32, F.lit(tw * scale)).otherwise(F.lit(0.0))


def cid_widths(ranges: DataFrame, key: str = "font") -> DataFrame:
    """(key, cid, width) from ranges (key, first, last, width)."""
    return ranges.select(key, F.explode(F.sequence("first", "last")).alias("cid"), "width")


def overlay(base: DataFrame, differences: DataFrame, key: list[str], value: str, seq: str = "seq") -> DataFrame:
    """Base encoding with differences laid over it; of several the latest wins."""
    w = Window.partitionBy(*key).orderBy(F.desc("_over"), F.desc(seq))
    both = base.withColumns({"_over": F.lit(0), seq: F.lit(0).cast("long")}).select(*key, value, "_over", seq).unionByName(differences.withColumn("_over", F.lit(1)).select(*key, value, "_over", seq))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*key, value)


def used_codes(glyphs: DataFrame, key: list[str], code: str = "code") -> DataFrame:
    """(key, codes): the distinct codes, sorted."""
    return glyphs.groupBy(*key).agg(F.array_sort(F.collect_set(code)).alias("codes"))


def subset_tag(digest_of: Column) -> Column:
    """Six letters from the first bytes of a SHA-256."""
    h = F.sha2(digest_of, 256)
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")
    return F.concat(*[F.chr((F.lit(65) + byte(i) % 26).cast("long")) for i in range(6)])


def checksum(data: Column) -> Column:
    """Sum of big-endian 32-bit words modulo 2**32, the last one padded with zeros."""
    @F.arrow_udf("long")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([int(np.frombuffer((v or b"") + bytes(-len(v or b"") % 4), dtype=">u4").sum(dtype=np.uint64)) & 0xFFFFFFFF for v in (x.as_py() for x in part)], pa.int64())

    return run(data.cast("binary"))
