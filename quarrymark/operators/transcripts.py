"""Folding revised, repeated, late and missing transcript chunks into one text per utterance.

Input rows are (session, utterance, seq, idx, text): ``seq`` is the arrival order, ``idx`` the chunk they write.  An utterance is
spoken by one person in one go, so its chunks form a small group; sessions of any size spread over their utterances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UTT = ["session", "utterance"]


def statuses(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """Add ``status``: what each arrival did to the transcript.  ``ends`` holds (session, utterance, end_seq)."""
    rows = chunks.join(ends, UTT, "left")
    open_ = F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq"))
    live = rows.where(open_)
    same = Window.partitionBy(*UTT, "idx").orderBy("seq")
    before = Window.partitionBy(*UTT).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.lag("text").over(same)
    top = F.coalesce(F.max("idx").over(before), F.lit(-1))
    status = (
        F.when(F.col("prev") == F.col("text"), "duplicate")
        .when(F.col("prev").isNotNull(), "revision")
        .when(F.trim("text") == "", "empty")
        .when(F.col("idx") < F.col("top"), "out_of_order")
        .when(F.col("idx") > F.col("top") + 1, "gap")
        .otherwise("accepted")
    )
    judged = live.withColumn("prev", prev).withColumn("top", top).withColumn("status", status).drop("prev", "top")
    return judged.unionByName(rows.where(~open_).withColumn("status", F.lit("rejected_finalized")))


def fold_latest(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """(session, utterance, idx, text, n_arrivals): the last accepted text of every chunk."""
    rows = chunks.join(ends, UTT, "left").where(F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq")))
    return rows.groupBy(*UTT, "idx").agg(F.max_by("text", "seq").alias("text"), F.count(F.lit(1)).alias("n_arrivals"))


def assembled(parts: Column) -> Column:
    """Chunk texts in index order, no space before closing punctuation."""
    texts = F.filter(F.transform(F.array_sort(parts), lambda p: F.trim(p["text"])), lambda x: x != "")
    return F.regexp_replace(F.array_join(texts, " "), r" ([,.;:?!)\]'’])", "$1")


def transcripts(folded: DataFrame) -> DataFrame:
    """(session, utterance, transcript, missing): the text so far and the chunk indices nobody has seen."""
    per = folded.groupBy(*UTT).agg(
        F.collect_list(F.struct("idx", "text")).alias("parts"), F.collect_set("idx").alias("have"), F.max("idx").alias("top")
    )
    return per.select(
        *UTT,
        assembled(F.col("parts")).alias("transcript"),
        F.array_sort(F.array_except(F.sequence(F.lit(0), F.col("top")), F.col("have"))).alias("missing"),
    )


def coalesced(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """Pending arrivals worth processing: an earlier write of a chunk is dropped unless the utterance ended in between."""
    last = F.max("seq").over(Window.partitionBy(*UTT, "idx"))
    rows = chunks.join(ends, UTT, "left").withColumn("last_seq", last)
    barrier = (F.col("seq") < F.col("end_seq")) & (F.col("end_seq") < F.col("last_seq"))
    return rows.where((F.col("seq") == F.col("last_seq")) | F.coalesce(barrier, F.lit(False))).drop("last_seq", "end_seq")


def release_waits(chunks: DataFrame, hold: int) -> DataFrame:
    """First arrival of every chunk, how long it waits for earlier ones (at most ``hold``), and whether a gap precedes it."""
    first = chunks.groupBy(*UTT, "idx").agg(F.min("seq").alias("arrived"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*UTT).orderBy("idx")
    ready = F.max("arrived").over(w.rowsBetween(Window.unboundedPreceding, 0))
    gap = F.col("idx") > F.coalesce(F.lag("idx").over(w), F.lit(-1)) + 1
    return first.select(
        *UTT,
        "idx",
        F.least(ready - F.col("arrived"), F.lit(hold)).alias("wait"),
        gap.alias("after_gap"),
        (F.col("n") - 1).alias("repeats"),
    )
