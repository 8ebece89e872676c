"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding, each written as Parquet and read again.

Defined results: null, blank and short texts fall by the quality rules; of linked texts that of the smallest id stays, a row without
an id is linked with nothing and stays; rows that repeat id and text count once from near_dedup on; a null source is a source of its
own; further columns pass through untouched, but none may be called shard; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotline.llm.common import stored
from shotline.llm.decontaminate import decontamination_filter
from shotline.llm.mixing import mixed
from shotline.llm.near_dedup import dedup_filter
from shotline.llm.quality_rules import quality_filter
from shotline.llm.sharding import with_shard

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the table of thresholds keeps."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return dedup_filter(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination_filter(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, 0 to 7, near equal in bytes."""
    return with_shard(docs, shards=8)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express Newton's iterations; test_run_equals_brute_force holds run() against one: exact rows up to mixing, then targets and shards.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
