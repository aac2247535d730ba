"""Fusing the ranked lists of several needs of one request.

Input lists are ``(uid, intent, intent_ord, item, section, score, rank)`` with at most k rows per need, so every group
below is bounded by (needs per request) x k whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.config import FUSION, RETRIEVAL
from quarrymark.operators.rank import reciprocal, top_k


def concat_lists(lists: DataFrame, k: int = FUSION.top_k) -> DataFrame:
    """Lists one after another in need order, duplicates kept."""
    return top_k(lists, ["uid"], F.col("intent_ord").asc(), F.col("rank").asc(), k=k, name="fused_rank")


def global_score(lists: DataFrame, k: int = FUSION.top_k) -> DataFrame:
    """Best raw score of each item over all needs."""
    best = lists.groupBy("uid", "item").agg(F.max("score").alias("score"))
    return top_k(best, ["uid"], F.col("score").desc(), F.col("item").asc(), k=k, name="fused_rank")


def rrf_lists(lists: DataFrame, k: int = FUSION.top_k, rrf_k: int = RETRIEVAL.rrf_k) -> DataFrame:
    """Reciprocal rank sum of each item over all needs."""
    fused = lists.groupBy("uid", "item").agg(
        F.round(F.sum(reciprocal(F.col("rank"), rrf_k)), 12).alias("rrf"),
        F.count(F.lit(1)).alias("n_intents"),
        F.min_by("intent", F.struct("rank", "intent_ord")).alias("owner"),
    )
    return top_k(fused, ["uid"], F.col("rrf").desc(), F.col("item").asc(), k=k, name="fused_rank")


def collect_hits(lists: DataFrame) -> DataFrame:
    """One row per item with all its hits: which needs found it, where, and who found it best."""
    return lists.groupBy("uid", "item").agg(
        F.array_sort(F.collect_list(F.struct("intent_ord", "intent", "rank"))).alias("hits"),
        F.count(F.lit(1)).alias("n_hits"),
        F.countDistinct("intent").alias("n_intents"),
        F.min("rank").alias("best_rank"),
    )


def collect_stats(lists: DataFrame) -> DataFrame:
    """Per request: hits in, unique items, items found by more than one need."""
    per_item = lists.groupBy("uid", "item").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("intent").alias("i"))
    return per_item.groupBy("uid").agg(
        F.sum("n").alias("input_hits"),
        F.count(F.lit(1)).alias("unique_items"),
        F.count_if(F.col("i") > 1).alias("cross_intent_duplicates"),
    )


def intent_aware(
    lists: DataFrame, top: int = FUSION.top_k, floor: int = FUSION.floor, cap: int = FUSION.section_cap
) -> DataFrame:
    """(uid, item, intent, pick): the floor guarantees every need its best items before the rest competes.

    A need offers at most ``cap`` items of one section.  Its first ``floor`` offers come in turns over the needs, all others after
    them by rank; an item picked in a turn, or offered better by another need, does not compete again.  ``top`` counts items, so
    an item that serves two needs takes one place.  All windows span the lists of one request.
    """
    best = lambda *keys: Window.partitionBy("uid", *keys).orderBy("rank", "item")
    offers = (
        lists.select("uid", "intent", "intent_ord", "item", "section", "rank")
        .withColumn("in_section", F.row_number().over(best("intent", "section")))
        .where(F.col("in_section") <= cap)
        .withColumn("turn", F.row_number().over(best("intent")))
    )
    guaranteed = F.col("turn") <= floor
    order = F.struct(
        F.when(guaranteed, 0).otherwise(1).alias("phase"),
        F.when(guaranteed, F.col("turn")).otherwise(F.col("rank")).alias("at"),
        F.col("intent_ord"),
        F.col("item"),
    )
    per_item = Window.partitionBy("uid", "item").orderBy("order")
    standing = (
        offers.withColumn("order", order)
        .withColumn("copy", F.row_number().over(per_item))
        .where((F.col("order.phase") == 0) | (F.col("copy") == 1))
    )
    places = Window.partitionBy("uid").orderBy("order")
    placed = standing.withColumn("place", F.sum((F.col("copy") == 1).cast("int")).over(places)).withColumn(
        "place", F.min("place").over(Window.partitionBy("uid", "item"))
    )
    return placed.where(F.col("place") <= top).select("uid", "item", "intent", F.row_number().over(places).alias("pick"))


def labelled(picks: DataFrame) -> DataFrame:
    """Evidence labels E1..En in order of first pick."""
    first = picks.groupBy("uid", "item").agg(F.min("pick").alias("first_pick"))
    w = Window.partitionBy("uid").orderBy("first_pick")
    return first.select("uid", "item", F.concat(F.lit("E"), F.row_number().over(w).cast("string")).alias("label"))


def intent_coverage(lists: DataFrame, picks: DataFrame, floor: int = FUSION.floor) -> DataFrame:
    """Per need: how many of its hits were selected (by any need), and whether it is covered."""
    kept = picks.select("uid", "item").distinct()
    found = lists.join(kept.withColumn("kept", F.lit(True)), ["uid", "item"], "left")
    return found.groupBy("uid", "intent").agg(
        F.count_if("kept").alias("n_selected"),
        F.coalesce(F.bool_or("kept"), F.lit(False)).alias("covered"),
        (F.count_if("kept") >= F.least(F.count(F.lit(1)), F.lit(floor))).alias("floor_met"),
    )


def capped(ranked: DataFrame, keys: list[str], cap: int, rank: str = "rank") -> DataFrame:
    """The ``cap`` best rows of every group."""
    return top_k(ranked, keys, F.col(rank).asc(), k=cap, name="rank_in_group")


def same_section(picks: DataFrame) -> DataFrame:
    """Related evidence: selected items of the same request and section (at most top_k items per request)."""
    a = picks.select("uid", "section", F.col("item").alias("source"))
    b = picks.select("uid", "section", F.col("item").alias("target"))
    return a.join(b, ["uid", "section"]).where(F.col("source") < F.col("target"))
