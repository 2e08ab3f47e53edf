"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the tagger rejects go;
2. near_dedup: of each group of near-copies one document stays;
3. decontaminate: documents that hold a window of ten words of a benchmark item go;
4. mix: sources are sampled to their target weights, by whole epochs and an exact cut;
5. shard: the rows go through the shard store and come back with their shard.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, mixing, sharding, simhash, toxicity
from quire.llm.common import remove, shared_dir, table, written


class _Left(threading.local):
    """What the stage before wrote on its way, in this thread; its output has been written and read again since, so it can go.

    The stages of a run are called in their order, in one thread; a run in another thread has its own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_LEFT = _Left()


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, [p for p in _LEFT.paths if p in written()])
        mark = len(written())
        out = work(spark, docs, sf_dir)
        _LEFT.paths = written()[mark:]
        return out

    return run_one


@_stage
def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


@_stage
def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


@_stage
def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialize(docs)


@_stage
def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("shard", stage_shard),
]

#: The first two stages have no SQL: a trained tagger, and components over XXH64 fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/quire/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
