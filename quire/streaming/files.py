"""Arriving files as a stream through the same parsers; each file is read once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, parse: Callable[[DataFrame], DataFrame], pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """A streaming table: ``parse`` gets (doc_id, content), where ``doc_id`` is the path."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return parse(files.select(F.col("path").alias("doc_id"), "content"))
