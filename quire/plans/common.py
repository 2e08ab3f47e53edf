"""Inputs that the queries derive from the driver tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows for work that costs far more than to move them: a table of few splits is dealt to all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(4 * cores)


#: Rows of a task where all rows of a key meet.
TASK_ROWS = 1 << 18


def dealt_by(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a key in one task, and about as many rows in a task whatever the size of the table."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)), key)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, r_, c_, r, g, b): marked pixels of four pages of 64 by 64, from line items."""
    level = lambda c, k: F.floor(F.max(c) * k + 0.5).cast("int")
    return (
        table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("page"), (F.col("l_orderkey") % 64).alias("r_"), (F.col("l_partkey") % 64).alias("c_"))
        .agg(level("l_quantity", 5.1).alias("r"), level("l_discount", 2550).alias("g"), level("l_tax", 3187).alias("b"))
    )


PIXELS_SQL = """px as (select l_suppkey % 4 as page, l_orderkey % 64 as r_, l_partkey % 64 as c_, cast(floor(max(l_quantity) * 5.1 + 0.5) as int) as r,
  cast(floor(max(l_discount) * 2550 + 0.5) as int) as g, cast(floor(max(l_tax) * 3187 + 0.5) as int) as b from lineitem group by 1, 2, 3)"""


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, tok, x, y, w, h): words of documents set on lines of ten, with wobbling baselines."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "tok")).where("tok <> ''")
    p = F.col("pos")
    return words.select(
        "doc_id", "pos", F.translate("tok", "\n\r\t", "___").alias("tok"), ((p % 10).cast("double") * 50 + p % 3).alias("x"), (F.lit(700.0) - F.floor(p / 10).cast("double") * 12 + p % 2 * 3).alias("y"),
        (F.char_length("tok").cast("double") * 6).alias("w"), (F.lit(10.0) + F.floor(F.col("doc_id") % 3).cast("double") * F.when(F.floor(p / 10) == 0, 4).otherwise(0)).alias("h"),
    )


def glyph_arrays(text: str, doc_id: int | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, pos, x, y, w, h) of one document in memory, as of ``glyphs``."""
    words = text.translate({10: "_", 13: "_", 9: "_"}).split(" ")
    p = np.array([i for i, t in enumerate(words) if t], dtype=np.int64)
    words = [t for t in words if t]
    large = np.nan if doc_id is None else math.fmod(doc_id, 3) * 4
    return words, p, p % 10 * 50.0 + p % 3, 700.0 - p // 10 * 12.0 + p % 2 * 3, np.array([len(t) * 6.0 for t in words]), 10.0 + np.where(p < 10, large, large * 0.0)


GLYPHS_SQL = r"""g as (select doc_id, pos, translate(tok, chr(10) || chr(13) || chr(9), '___') as tok, cast(pos % 10 as double) * 50 + pos % 3 as x, 700.0::double - cast(pos // 10 as double) * 12 + (pos % 2) * 3 as y,
  cast(length(tok) as double) * 6 as w, 10.0::double + cast(doc_id % 3 as double) * (case when pos // 10 = 0 then 4 else 0 end) as h
  from (select doc_id, unnest(range(len(a))) as pos, unnest(a) as tok from (select doc_id, string_split(text, ' ') as a from documents)) where tok <> '')"""
