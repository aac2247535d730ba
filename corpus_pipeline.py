"""From raw documents to training shards: every stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymark.llm import decontamination, histogram_sort, mixing, quality_rules, simhash, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that holds nothing else goes."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontamination.cleaned(docs, items)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; what an over-represented source has left over goes."""
    return mixing.taken(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document moves to a shard of near-equal bytes and gets its slot there."""
    return histogram_sort.sharded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

# Fingerprints, suffix positions and refined splitters have no SQL form; tests hold every stage against plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written to the shared folder and read again by the next.

    What a stage has written on its way is removed when its result stands; of the results only the one that the last stage reads
    outlives this call.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    with store.temporary(spark):
        for position, (name, stage) in enumerate(STAGES[:-1]):
            with store.temporary(spark):
                docs = store.written(stage(spark, docs, sf_dir), name, up=2 if position == len(STAGES) - 2 else 1)
    return STAGES[-1][1](spark, docs, sf_dir)
