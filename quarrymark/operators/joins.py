"""Joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than one percent of the rows, so there are fewer than 100 hot keys by counting alone.
HOT_SHARE = 100


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Inner-join rows with one row per key, where ``per_key[count]`` is the number of rows of that key.

    Hot keys (fewer than 100 by construction, so their broadcast is bounded) are matched in place; only the evenly spread
    rest is shuffled.
    """
    total = per_key.agg(F.sum(count)).scalar()
    hot = per_key.where(F.col(count) * HOT_SHARE > total)
    cold = per_key.where(F.col(count) * HOT_SHARE <= total)
    in_place = rows.join(F.broadcast(hot), keys)
    shuffled = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return in_place.unionByName(shuffled)
