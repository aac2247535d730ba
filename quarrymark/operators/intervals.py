"""Pairs of intervals that overlap, for intervals of any length.

An interval belongs to the dyadic level of its length: bins as wide as the next power of two, of which it touches one or two.  The
shorter of two intervals looks for the longer one in the bins of its own and every coarser level, again at most two each.  So an
interval makes a row or two for every level that occurs, however long it is, and the join is an ordinary hash join on (keys, level,
bin).  A key that holds a third of all rows is spread over its bins.  Two intervals that share two bins meet once, in the later one
of their first common bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """Smallest level whose bins are at least as wide as the interval."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def overlaps(left: DataFrame, keys: list[str], id_: str, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, a, b, shared, ratio): pairs of one key that share more than nothing; ``ratio`` is the share of the shorter interval.

    ``a`` is the one that starts first, by id where both start together.  Ends are exclusive; empty and reversed intervals and
    those with a null overlap nothing; intervals without a key (null) meet no other; ids are unique inside a key.
    """
    rows = left.select(*keys, F.col(id_).alias("id"), F.col(start).alias("s"), F.col(end).alias("e")).where("s < e")
    sized = rows.withColumn("level", _level(F.col("e") - F.col("s")))
    last = sized.agg(F.max("level")).scalar()

    def bins(frame: DataFrame, at: Column) -> DataFrame:
        """One row for every bin of the level that the interval touches."""
        span = F.sequence(_bin(F.col("s"), at), _bin(F.col("e") - 1, at))
        return frame.select("*", F.explode(span).alias("bin"))

    held = bins(sized, F.col("level"))
    seeking = sized.withColumnRenamed("level", "own").select("*", F.explode(F.sequence("own", last)).alias("level"))
    asked = bins(seeking, F.col("level"))
    x = asked.select(*keys, "level", "bin", *[F.col(c).alias(f"x_{c}") for c in ("id", "s", "e", "own")])
    y = held.select(*keys, "level", "bin", *[F.col(c).alias(f"y_{c}") for c in ("id", "s", "e")])
    # of two intervals of one level each looks for the other: one way is enough
    once = (F.col("x_own") < F.col("level")) | (F.col("x_id") < F.col("y_id"))
    first = F.greatest(_bin(F.col("x_s"), F.col("level")), _bin(F.col("y_s"), F.col("level")))
    met = x.join(y, [*keys, "level", "bin"]).where(once & (F.col("x_id") != F.col("y_id")) & (F.col("bin") == first))
    shared = F.least("x_e", "y_e") - F.greatest("x_s", "y_s")
    shorter = F.least(F.col("x_e") - F.col("x_s"), F.col("y_e") - F.col("y_s"))
    ahead = F.struct("x_s", "x_id") < F.struct(F.col("y_s").alias("x_s"), F.col("y_id").alias("x_id"))
    return met.where(shared > 0).select(
        *keys,
        F.when(ahead, F.col("x_id")).otherwise(F.col("y_id")).alias("a"),
        F.when(ahead, F.col("y_id")).otherwise(F.col("x_id")).alias("b"),
        shared.alias("shared"),
        F.round(shared / shorter, 6).alias("ratio"),
    )
