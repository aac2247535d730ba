"""Event-log analytics: sessions, gaps, milestones, ordering, traces, concurrency.

A user may own any share of the log, so ordered work is cut into hours (see ``ordered.Split``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymark.operators.ordered import Split
from quarrymark.session import durable


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hourly(keys: list[str], order: list[str], at: str = "us") -> Split:
    return Split(keys, order, F.floor(F.col(at) / 3_600_000_000))


def sessions(events: DataFrame, key: str, gap_us: int) -> DataFrame:
    """Add ``session``: a silence longer than ``gap_us`` starts the next one."""
    split = hourly([key], ["us", "event_id"])
    prev = split.lag(events, before="us")
    starts = F.when(F.col("before").isNull() | (F.col("us") - F.col("before") > gap_us), 1).otherwise(0).cast("long")
    return split.running_sum(prev, "session", starts).drop("before")


def session_spans(events: DataFrame, key: str, gap_us: int) -> DataFrame:
    return sessions(events, key, gap_us).groupBy(key, "session").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n_events")
    )


def gaps(events: DataFrame, key: str) -> DataFrame:
    """Add the time since the previous event of the key."""
    return hourly([key], ["us", "event_id"]).lag(events, before="us").withColumn("gap_us", F.col("us") - F.col("before"))


def first_after(events: DataFrame, keys: list[str], start: Column, of: dict[str, Column]) -> DataFrame:
    """Milestones: per key the time from the first ``start`` event to the first event of each kind."""
    t0 = F.min(F.when(start, F.col("us")))
    marks = [F.min(F.when(cond, F.col("us"))).alias(name) for name, cond in of.items()]
    found = events.groupBy(*keys).agg(t0.alias("t0"), *marks)
    return found.select(*keys, *[(F.col(n) - F.col("t0")).alias(n) for n in of])


def peak_concurrency(spans: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Largest number of open spans per key; at equal times an end counts before a start.

    +1/-1 steps are summed per instant first, so the ordered pass sees one row per instant.
    """
    ups = spans.select(*keys, F.col(start).alias("us"), F.lit(1).alias("rank"), F.lit(1).cast("long").alias("step"))
    downs = spans.select(*keys, F.col(end).alias("us"), F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("step"))
    steps = ups.unionByName(downs).groupBy(*keys, "us", "rank").agg(F.sum("step").alias("step"))
    open_ = hourly(keys, ["us", "rank"]).running_sum(steps, "open", F.col("step"))
    return open_.groupBy(*keys).agg(F.max("open").alias("peak"))


def orphans(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows that name a parent nobody has."""
    ids = nodes.select(F.col(key).alias(parent))
    return nodes.where(F.col(parent).isNotNull()).join(ids, parent, "left_anti")


def roots(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, hops): parents are followed by pointer doubling until no row moves.

    Each round doubles the hops behind a pointer and is cut off by a checkpoint.  A chain of n nodes settles in log2(n) rounds; what
    still moves after that runs in a circle and gets no root.
    """
    links = nodes.select(
        F.col(key).alias("k"),
        F.coalesce(parent, key).alias("up"),
        F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("hops"),
        F.col(parent).isNotNull().alias("open"),
    )
    links = durable(links)
    rounds = max(links.count(), 1).bit_length() + 1
    while rounds and not links.where("open").isEmpty():
        above = links.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("more"))
        steps = links.join(above, "up", "left")
        links = durable(
            steps.select(
                "k",
                F.coalesce("up2", "up").alias("up"),
                (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                (F.coalesce("more", F.lit(0)) > 0).alias("open"),
            )
        )
        rounds -= 1
    root, hops = (F.when(~F.col("open"), F.col(c)) for c in ("up", "hops"))
    return links.select(F.col("k").alias(key), root.alias("root"), hops.alias("hops"))
