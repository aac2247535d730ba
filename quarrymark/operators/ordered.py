"""Ordered analytics over keys of any size.

A plain window sends a whole key to one task.  Here each key is cut into buckets of its order (an hour of events, a block of
turns); windows run inside (key, bucket), each bucket is summarised to one row, and only those summaries are ordered per key
to carry values across bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Split:
    """Ordered operations by ``keys`` and ``order``; ``bucket`` is a non-decreasing function of the first order column."""

    def __init__(self, keys: list[str], order: list[str], bucket: Column) -> None:
        self.keys = keys
        self.order = order
        self.bucket = bucket

    def _local(self) -> Window:
        return Window.partitionBy(*self.keys, "_bucket").orderBy(*self.order)

    def _across(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy("_bucket")

    def lag(self, df: DataFrame, **columns: str) -> DataFrame:
        """Add ``name=source`` columns holding the previous row's value."""
        rows = df.withColumn("_bucket", self.bucket)
        packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
        last = rows.groupBy(*self.keys, "_bucket").agg(F.max_by(packed, F.struct(*self.order)).alias("_last"))
        carry = last.select(*self.keys, "_bucket", F.lag("_last").over(self._across()).alias("_carry"))
        local = rows.withColumn("_prev", F.lag(packed).over(self._local()))
        both = local.join(carry, [*self.keys, "_bucket"], "left").withColumn("_prev", F.coalesce("_prev", "_carry"))
        return both.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in columns])

    def lead(self, df: DataFrame, **columns: str) -> DataFrame:
        """Add ``name=source`` columns holding the next row's value."""
        rows = df.withColumn("_bucket", self.bucket)
        packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
        first = rows.groupBy(*self.keys, "_bucket").agg(F.min_by(packed, F.struct(*self.order)).alias("_first"))
        carry = first.select(*self.keys, "_bucket", F.lead("_first").over(self._across()).alias("_carry"))
        local = rows.withColumn("_next", F.lead(packed).over(self._local()))
        both = local.join(carry, [*self.keys, "_bucket"], "left").withColumn("_next", F.coalesce("_next", "_carry"))
        return both.select(*df.columns, *[F.col(f"_next.{n}").alias(n) for n in columns])

    def running_sum(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """Add the inclusive running total of ``value``."""
        rows = df.withColumn("_bucket", self.bucket).withColumn("_value", value)
        total = rows.groupBy(*self.keys, "_bucket").agg(F.sum("_value").alias("_total"))
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        carry = total.select(
            *self.keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry")
        )
        upto = self._local().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = rows.withColumn("_local", F.sum("_value").over(upto))
        both = local.join(carry, [*self.keys, "_bucket"], "left")
        return both.select(*df.columns, (F.col("_local") + F.col("_carry")).alias(name))

    def position(self, df: DataFrame, name: str = "position") -> DataFrame:
        """Add the 1-based position inside the key."""
        return self.running_sum(df, name, F.lit(1).cast("long"))


def islands(df: DataFrame, split: Split, value: str, name: str = "island") -> DataFrame:
    """Number the runs of consecutive integers: a new run starts where the value does not follow its predecessor."""
    prev = split.lag(df, _before=value)
    starts = F.when(F.col("_before").isNull() | (F.col(value) != F.col("_before") + 1), 1).otherwise(0).cast("long")
    return split.running_sum(prev, name, starts).drop("_before")
