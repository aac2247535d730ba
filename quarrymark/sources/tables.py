"""Parquet tables by name, read lazily so that Catalyst prunes columns and pushes filters per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


SPREAD_BYTES = 32 << 20
DEALT_BYTES = 2 << 20


class Tables:
    """Attribute access to the tables of one folder: ``Tables(spark, path).documents``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


    @property
    def index(self):
        """The lexical index of ``documents``, built at first use."""
        from quarrymark.sources.index import of_table

        return of_table(self.spark, f"{self.folder}/documents.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a frame by key when it is less than a split for every task slot, by the plan's own estimate of its bytes.

    A file of one row group is read by one task, however many splits it has.  What is larger than ``SPREAD_BYTES`` for every slot is
    left where it is, so no text is shuffled at scale.  The rows are the same either way.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size > slots * SPREAD_BYTES else df.repartition(slots, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a frame by key into parts of about ``DEALT_BYTES``, by the plan's own estimate of its bytes, that are not merged again.

    For rows of which many more are made: merging small parts looks only at the bytes of what is dealt.  There is a part for every
    task slot at least, and for every shuffle partition at most.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(slots, min(size // DEALT_BYTES, most)), *keys)
