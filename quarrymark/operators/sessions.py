"""What a turn changed: net changes, delta queries, context selection, guards, tracked needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def net_changes(changes: DataFrame, scope: list[str], item: str) -> DataFrame:
    """(scope, item, change): changes of one turn after cancelling what was both added and removed in it.

    ``changes`` has (scope, item, change) with change one of added, retracted, modified, kept.
    """
    per = changes.groupBy(*scope, item).agg(
        F.count_if(F.col("change") == "added").alias("plus"),
        F.count_if(F.col("change") == "retracted").alias("minus"),
        F.count_if(F.col("change") == "modified").alias("touched"),
    )
    kind = (
        F.when((F.col("plus") > 0) & (F.col("minus") > 0), None)
        .when(F.col("plus") > 0, "added")
        .when(F.col("minus") > 0, "retracted")
        .when(F.col("touched") > 0, "modified")
    )
    return per.select(*scope, item, kind.alias("change")).where(F.col("change").isNotNull())


def delta_terms(previous: Column, wanted: Column) -> Column:
    """Terms of the next query: what the previous one had and is still wanted, then what is new."""
    kept = F.filter(previous, lambda x: F.array_contains(wanted, x))
    return F.array_union(kept, F.array_except(wanted, previous))


def guard(position: Column, gap_us: Column, budget: int, cooldown_us: int) -> Column:
    """Why a search of an utterance may not run: its budget is spent, or the last one is too recent."""
    return (
        F.when(position > budget, "budget")
        .when(gap_us.isNotNull() & (gap_us < cooldown_us), "cooldown")
        .otherwise("retrieve")
    )


def tracked(current: DataFrame, previous: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, need, change, matched): needs that continue an earlier one are modified, the others are added; earlier needs without
    a continuation are removed.  ``pairs`` is the one-to-one matching (uid, a, b)."""
    matched = pairs.select("uid", F.col("a").alias("need"), F.col("b").alias("matched"))
    now = current.join(matched, ["uid", "need"], "left").select(
        "uid", "need", F.when(F.col("matched").isNull(), "added").otherwise("modified").alias("change"), "matched"
    )
    used = pairs.select("uid", F.col("b").alias("need"))
    gone = previous.join(used, ["uid", "need"], "left_anti").select(
        "uid", "need", F.lit("removed").alias("change"), F.lit(None).cast("long").alias("matched")
    )
    return now.unionByName(gone)
