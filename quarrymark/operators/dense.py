"""Exact vector search.

Vectors are dealt into slices and query vectors into blocks of bounded size; every slice meets every block in a group of its own,
scored with one matrix product, and each group emits at most k rows per query.  The numbers of slices and blocks follow the row
counts inside the plan, so neither side ever passes through the driver or a task as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymark.functions.text import analyse, let
from quarrymark.operators.rank import top_k
from quarrymark.sources.tables import spread

SLICE = 2048
BLOCK = 2048


def counted(rows: DataFrame) -> Column:
    """Row count as a value of the plan."""
    return rows.agg(F.count(F.lit(1))).scalar()


def _matrix(column: pd.Series, dim: int | None = None) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    if dim is not None and m.shape[1] != dim:
        raise ValueError(f"vector has {m.shape[1]} dimensions, query has {dim}")
    return m


def _each_group(
    vectors: DataFrame,
    queries: DataFrame,
    score: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    names: tuple[str, str, str],
    sizes: tuple[Column | None, Column | None],
) -> DataFrame:
    """(qid, key, score) rows that ``score(keys, ids, similarities)`` picks from every slice x block group."""
    key, vector, qid = names
    slices = F.ceil(F.greatest(counted(vectors) if sizes[0] is None else sizes[0], F.lit(1)) / SLICE)
    blocks = F.ceil(F.greatest(counted(queries) if sizes[1] is None else sizes[1], F.lit(1)) / BLOCK)
    mine = vectors.select(
        F.col(key).cast("long").alias("key"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.pmod(F.xxhash64(key), slices).alias("slice"),
        blocks.alias("n"),
    ).select("key", "vector", "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    asked = queries.select(
        F.col(qid).cast("long").alias("key"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.pmod(F.xxhash64(qid), blocks).alias("block"),
        slices.alias("n"),
    ).select("key", "vector", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slice"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "key": [], "score": []}).astype({"qid": "int64", "key": "int64", "score": "float64"})
        right = right.sort_values("key")
        q = _matrix(right["vector"])
        similar = np.round(_matrix(left["vector"], q.shape[1]) @ q.T, 6)
        ids, keys, scores = score(left["key"].to_numpy(), right["key"].to_numpy(), similar)
        return pd.DataFrame({"qid": ids, "key": keys, "score": scores})

    place = ["slice", "block"]
    grouped = mine.groupBy(*place).cogroup(asked.groupBy(*place))
    return grouped.applyInPandas(run, "qid long, key long, score double")


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "vec_id",
    vector: str = "embedding",
    qid: str = "qid",
    least: float | None = None,
    sizes: tuple[Column | None, Column | None] = (None, None),
) -> DataFrame:
    """(qid, key, score, rank) of the k most similar vectors of every query; ``sizes`` may tell the row counts of both sides."""

    def best(keys: np.ndarray, ids: np.ndarray, similar: np.ndarray):
        out = []
        for j in range(len(ids)):
            s = similar[:, j]
            rows = np.arange(len(s)) if least is None else np.flatnonzero(s >= least)
            top = rows[np.lexsort((keys[rows], -s[rows]))[:k]]
            out.append((np.repeat(ids[j], len(top)), keys[top], s[top]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    found = _each_group(vectors, queries, best, (key, vector, qid), sizes).withColumnRenamed("key", key)
    return top_k(found, ["qid"], F.col("score").desc(), F.col(key).asc(), k=k)


def relevance(candidates: DataFrame, needs: DataFrame, request: str = "uid", key: str = "vec_id", vector: str = "embedding"):
    """(request, qid, key, score): every candidate of a request against every need of the same request."""
    a = candidates.select(request, key, F.col(vector).cast("array<double>").alias("_a"))
    b = needs.select(request, "qid", F.col(vector).cast("array<double>").alias("_b"))
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, request).select(request, "qid", key, F.round(dot, 6).alias("score"))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    n: int,
    key: str = "vec_id",
    vector: str = "embedding",
    qid: str = "qid",
    sizes: tuple[Column | None, Column | None] = (None, None),
) -> DataFrame:
    """(key, qid, score, rank): the n closest queries of every vector; each group emits at most n rows a vector."""

    def closest(keys: np.ndarray, ids: np.ndarray, similar: np.ndarray):
        order = np.lexsort((np.broadcast_to(ids, similar.shape), -similar), axis=1)[:, :n]
        width = order.shape[1]
        return ids[order].ravel(), np.repeat(keys, width), np.take_along_axis(similar, order, axis=1).ravel()

    found = _each_group(vectors, queries, closest, (key, vector, qid), sizes)
    best = top_k(found, ["key"], F.col("score").desc(), F.col("qid").asc(), k=n)
    return best.withColumnRenamed("key", key)


def unit(components: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, embedding): unit vectors from (keys, pos, value) rows; an array has one entry per dimension."""
    packed = components.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("c"),
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"),
    )
    return packed.select(
        *keys, F.transform("c", lambda x: x["value"] / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("embedding")
    )


def prototypes(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, embedding): normalised mean vector of every label, combined per task before the shuffle."""
    rows = vectors.select(label, F.posexplode(F.col(vector)).alias("pos", "x"))
    means = rows.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))
    return unit(means, [label])


def features(tokens: Column) -> Column:
    """Terms and adjacent pairs."""

    def both(ts: Column) -> Column:
        shifted = F.slice(ts, 2, F.size(ts))
        pairs = F.zip_with(ts, shifted, lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
        return F.concat(ts, F.filter(pairs, lambda p: p.isNotNull()))

    return let(tokens, both)


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 64) -> DataFrame:
    """(key, embedding): signed feature hashing of terms and pairs to ``dim`` buckets, unit length."""
    rows = spread(docs.select(key, text), key).select(key, F.explode(features(analyse(F.col(text)))).alias("f"))
    code = F.conv(F.substring(F.md5("f"), 1, 8), 16, 10).cast("long")
    signed = rows.select(
        key,
        F.pmod(code, F.lit(dim)).cast("int").alias("bucket"),
        F.when(F.pmod(F.floor(code / dim), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"),
    )
    sums = signed.groupBy(key, "bucket").agg(F.sum("s").alias("v"))
    maps = sums.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("m"),
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"),
    )
    scale = F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    every = F.sequence(F.lit(0), F.lit(dim - 1))
    vector = F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / scale)
    return maps.select(key, vector.alias("embedding"))
