"""Ranking: deterministic top-k, rank fusion, caps.

``row_number() <= k`` compiles to a group limit on both sides of the exchange, so a hot group sends at most k rows per
task and its final rank is computed over tasks x k rows, never over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.config import RETRIEVAL


def top_k(df: DataFrame, keys: list[str], *order: Column, k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def reciprocal(rank: Column, k: int = RETRIEVAL.rrf_k) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def fuse_ranks(left: DataFrame, right: DataFrame, keys: list[str], k: int = RETRIEVAL.rrf_k) -> DataFrame:
    """Full outer union of two ranked lists (columns ``rank``) with the reciprocal rank sum of both."""
    a = left.select(*keys, F.col("rank").alias("left_rank"))
    b = right.select(*keys, F.col("rank").alias("right_rank"))
    part = lambda c: F.coalesce(reciprocal(F.col(c), k), F.lit(0.0))
    return a.join(b, keys, "full_outer").select(
        *keys,
        "left_rank",
        "right_rank",
        F.round(part("left_rank") + part("right_rank"), 12).alias("rrf"),
        F.least("left_rank", "right_rank").alias("best_rank"),
    )


def rrf_top(fused: DataFrame, group: str, item: str, k: int) -> DataFrame:
    return top_k(fused, [group], F.col("rrf").desc(), F.col("best_rank").asc(), F.col(item).asc(), k=k)
