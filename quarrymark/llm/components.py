"""Connected components of a large edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymark.llm.store import temporary, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the same label for all nodes that edges (a, b) connect; only nodes with an edge appear.

    Each round every node points to its smallest neighbour, pointers are followed twice, and edges are rewritten to the ends
    of their pointers; the graph that is left shrinks until it has no edge.  Every round is written to the shared folder, so a
    lost executor never repeats earlier rounds.
    """
    with temporary(edges.sparkSession):
        found = _contracted(edges)
        return written(found, "components", up=1)


def _contracted(edges: DataFrame) -> DataFrame:
    left = written(edges.where("a <> b").select("a", "b"), "edges")
    labels: DataFrame | None = None
    while not left.isEmpty():
        ways = left.union(left.select("b", "a"))
        near = ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        point = written(near.select("node", F.least("node", "m").alias("to")), "pointers")
        for _ in range(2):
            up = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
            point = point.join(up, "to").select("node", F.col("far").alias("to"))
        point = written(point, "pointers")

        def moved(frame: DataFrame, name: str, point: DataFrame = point) -> DataFrame:
            return frame.join(point.select(F.col("node").alias(name), "to"), name).drop(name).withColumnRenamed("to", name)

        left = written(moved(moved(left, "a"), "b").where("a <> b").select("a", "b").distinct(), "edges")
        if labels is None:
            labels = point.withColumnRenamed("to", "label")
        else:
            step = point.select(F.col("node").alias("label"), "to")
            joined = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = written(joined, "labels")
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
