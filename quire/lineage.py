"""Lineage cuts: tables in the folder that driver and executors share."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and runs on this machine alone (tests, a notebook) a
    fresh folder under /tmp/checkpoints is chosen and recorded in the session; a cluster has to name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file:///tmp/checkpoints/quire-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


class _Written(threading.local):
    """Folders that this thread wrote below the shared one, oldest first."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_WRITTEN = _Written()


def written() -> list[str]:
    return _WRITTEN.paths


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"
    written().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
