"""Approximate nearest neighbours: a robust-pruned directed graph per shard, beam search over every shard.

``build`` puts equal vectors together, deals the distinct ones into shards by hash and builds each shard's graph in a task of its
own (``pruned_graph``).  The index is a Parquet table with one row per distinct vector: shard, node, the smallest ids that have
it, the vector, its edges.  Every row of the table is in it: k + 1 ids of a vector are all that any answer can name, since ties go
to smaller ids.  A vector that a third of all rows share is one node, and its ids are cut to k + 1 before they are shuffled.

``search`` sends the queries to every shard in parts; a shard and a part of the queries meet in one task of bounded size.  What a
beam search meets is scored again in double precision on the original vectors, and each shard gives its k nearest.

The number of shards follows the data: one for ``LEAST_ROWS`` vectors, up to ``FEW_SHARDS``; these then grow up to
``SHARD_BYTES``; after that their number grows.

Defined cases: vectors that are null or zero or hold null or non-finite numbers take no part; vectors of another length than the
query's are no candidates; a null id takes no part; rows of the same id as the query's are not its candidates; rows equal in id and
vector count once; equal scores go to the smaller id; without candidates a query has no row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.llm.pruned_graph import Graph, built
from quarrymark.llm.store import written

K = 5
BEAM = 128
LEAST_ROWS = 8192
FEW_SHARDS = 64
SHARD_BYTES = 64 << 20
PART = 1 << 17
EVERY = 50

GRAPH = "shard int, node int, start boolean, ids array<long>, vector array<double>, edges array<int>"
FOUND = "query_id long, vec_id long, score double"


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & F.exists(vector, lambda x: x != 0)


def _vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    numbers = F.col(vector).cast("array<double>").alias("vector")
    rows = table.select(F.col(key).cast("long").alias("vec_id"), numbers)
    return rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))


def _matrices(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    found = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        found.append((rows, flat[first[rows][:, None] + np.arange(size)]))
    return found


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two, so that no square overflows, and their lengths."""
    scaled = np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1))[1][:, None])
    return scaled, np.sqrt(np.einsum("ij,ij->i", scaled, scaled))


def _graph(shard: pa.Table) -> pa.Table:
    n = shard.num_rows
    node, start = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool)
    edges: list[np.ndarray | None] = [None] * n
    for rows, matrix in _matrices(shard.column("vector")):
        scaled, length = _unit(matrix)
        graph = built((scaled / length[:, None]).astype(np.float32))
        node[rows] = np.arange(len(rows))
        start[rows[graph.start]] = True
        for row, mine in zip(rows.tolist(), graph.edges.astype(np.int32), strict=True):
            edges[row] = mine[mine >= 0]
    lists = pa.array(edges, pa.list_(pa.int32()))
    return pa.table(
        [shard.column("shard"), pa.array(node), pa.array(start), shard.column("ids"), shard.column("vector"), lists],
        names=["shard", "node", "start", "ids", "vector", "edges"],
    )


def shards_for(rows: int, size: int) -> int:
    """Number of shards for so many vectors of so many bytes."""
    return max(1, -(-size // SHARD_BYTES), min(FEW_SHARDS, -(-rows // LEAST_ROWS)))


def build(table: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index: one row per distinct vector."""
    rows = _vectors(table, key, vector).withColumn("hash", F.xxhash64("vector"))
    place = F.dense_rank().over(Window.partitionBy("hash", "vector").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = few.groupBy("hash", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    distinct = written(classes, "vectors")
    count, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(4 * F.size("vector")), F.lit(0))).first()
    shard = F.pmod("hash", F.lit(shards_for(count, size))).cast("int").alias("shard")
    dealt = distinct.select(shard, "ids", "vector")
    return written(dealt.groupBy("shard").applyInArrow(_graph, GRAPH), "graph")


def _nearest(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, names: pa.ListArray, graph: Graph, beam: int, k: int):
    """(query id, vec_id, score) of the k nearest rows of each query."""
    asked, lengths = _unit(queries)
    scaled, sizes = _unit(matrix)
    counts = names.value_lengths().to_numpy()
    flat = names.flatten().to_numpy()
    first = np.cumsum(counts) - counts
    out = []
    for at in range(0, len(queries), 512):
        q = asked[at : at + 512]
        nodes = graph.search((q / lengths[at : at + 512, None]).astype(np.float32), beam)
        r, c = np.nonzero(nodes >= 0)
        node = nodes[r, c]
        score = np.einsum("ij,ij->i", scaled[node], q[r]) / (sizes[node] * lengths[at + r])
        # every node stands for its ids
        times = counts[rows[node]]
        query = np.repeat(r, times)
        inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        vec = flat[np.repeat(first[rows[node]], times) + inside]
        score = np.repeat(score, times)
        other = vec != ids[at + query]
        query, vec, score = query[other], vec[other], score[other]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        # an id of two different vectors is one candidate, by the nearer
        _, once = np.unique(np.stack((query, vec)), axis=1, return_index=True)
        keep = np.sort(once)
        query, vec, score = query[keep], vec[keep], score[keep]
        begin = np.searchsorted(query, query)
        top = np.arange(len(query)) - begin < k
        out.append((ids[at + query[top]], vec[top], score[top]))
    return [np.concatenate(parts) for parts in zip(*out, strict=True)]


def _answers(shard: pa.Table, queries: pa.Table, beam: int, k: int) -> pa.Table:
    found = []
    if shard.num_rows and queries.num_rows:
        asked = {m.shape[1]: (rows, m) for rows, m in _matrices(queries.column("vector"))}
        names = shard.column("ids").combine_chunks()
        edge_lists = shard.column("edges").combine_chunks()
        node, start = shard.column("node").to_numpy(), shard.column("start").to_numpy()
        query_ids = queries.column("vec_id").to_numpy()
        for rows, matrix in _matrices(shard.column("vector")):
            if matrix.shape[1] not in asked:
                continue
            order = np.argsort(node[rows])
            rows, matrix = rows[order], matrix[order]
            counts = edge_lists.value_lengths().to_numpy()[rows]
            flat, first = edge_lists.flatten().to_numpy(), np.cumsum(edge_lists.value_lengths().to_numpy())
            begin = first[rows] - counts
            edges = np.full((len(rows), max(int(counts.max()), 1)), -1, dtype=np.int64)
            line = np.repeat(np.arange(len(rows)), counts)
            column = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            edges[line, column] = flat[np.repeat(begin, counts) + column]
            scaled, length = _unit(matrix)
            graph = Graph((scaled / length[:, None]).astype(np.float32), edges, int(np.flatnonzero(start[rows])[0]))
            which, vectors = asked[matrix.shape[1]]
            found.append(_nearest(vectors, query_ids[which], rows, matrix, names, graph, beam, k))
    columns = [np.concatenate(parts) for parts in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row, by cosine."""
    asked = _vectors(queries, key, vector).dropDuplicates(["vec_id", "vector"])
    shards, parts = index.agg(F.coalesce(F.max("shard") + 1, F.lit(0))).first()[0], -(-asked.count() // PART)
    if not shards or not parts:
        empty = index.sparkSession.createDataFrame([], FOUND)
        return empty.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = asked.withColumns(
        {"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "part": F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")}
    )
    near = dealt.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInArrow(
        lambda shard, some: _answers(shard, some, max(beam, k + 1), k), FOUND
    )
    # a query id with two vectors asks with both and takes the nearer answer
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digests(table: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 50 asks all rows."""
    return search(build(table), table.where(F.col("vec_id") % EVERY == 0))
