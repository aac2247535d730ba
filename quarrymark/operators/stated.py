"""Filters that the user has stated.

A value of a metadata field that occurs in a question is a filter only when the question asks for it: all its words are words of a
stated constraint, or it stands within three words after a word that marks one.  That a document has the value creates no filter.

Values are phrases in a table.  The questions' phrases of the lengths that values have meet them by a hash join, and are counted before
they are shuffled: a question sends one row a phrase, however often it says it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[a-z0-9][a-z0-9-]*"
REACH = 3


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def marked_phrases(questions: DataFrame, markers: list[str], lengths: list[int]) -> DataFrame:
    """(qid, phrase, marked): at every word the phrases of these lengths, and whether one of the ``REACH`` words before is a marker."""
    ws = questions.select("qid", words(F.col("text")).alias("ws"))
    entry = F.transform(
        "ws",
        lambda w, i: F.struct(
            F.array(*[F.when(i + n <= F.size("ws"), F.array_join(F.slice("ws", i + 1, F.lit(n)), " ")) for n in lengths]).alias("phrases"),
            F.exists(F.slice("ws", F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))), lambda b: b.isin(*markers)).alias("marked"),
        ),
    )
    places = ws.select("qid", F.explode(entry).alias("e"))
    return places.select("qid", F.explode("e.phrases").alias("phrase"), "e.marked").where("phrase IS NOT NULL")


def stated(questions: DataFrame, values: DataFrame, markers: list[str]) -> DataFrame:
    """(qid, field, value, n_found, by_constraint, by_marker) of every value found in a question that the user has stated.

    ``questions`` has (qid, text, constraint): the text of the constraints stated so far, or null.  ``values`` has (field, value); a
    value without a word is never found, and a repeated one counts once.
    """
    phrases = values.select("field", "value").distinct().select("field", "value", words(F.col("value")).alias("ts")).where(F.size("ts") > 0)
    lengths = sorted(r["n"] for r in phrases.select(F.size("ts").alias("n")).distinct().collect())  # a few numbers
    said = marked_phrases(questions, markers, lengths or [1])
    # one row for a phrase of a question, whatever the fields and values that name it
    per_phrase = said.join(phrases.select(F.array_join("ts", " ").alias("phrase")).distinct(), "phrase", "left_semi")
    per_phrase = per_phrase.groupBy("qid", "phrase").agg(F.count(F.lit(1)).alias("n_found"), F.max("marked").alias("by_marker"))
    found = per_phrase.join(phrases.select("field", "value", F.array_join("ts", " ").alias("phrase")), "phrase").drop("phrase")
    steps = phrases.select("field", "value", F.explode("ts").alias("word"))
    asked = questions.select("qid", F.explode(F.array_distinct(words(F.col("constraint")))).alias("word"))
    distinct = steps.select("field", "value", "word").distinct()
    needed = distinct.groupBy("field", "value").agg(F.count(F.lit(1)).alias("needed"))
    covered = asked.join(distinct, "word").groupBy("qid", "field", "value").agg(F.count(F.lit(1)).alias("covered"))
    full = covered.join(needed, ["field", "value"]).where("covered = needed").select("qid", "field", "value", F.lit(True).alias("inside"))
    rows = found.join(full, ["qid", "field", "value"], "left")
    by_constraint = F.coalesce("inside", F.lit(False))
    return rows.select("qid", "field", "value", "n_found", by_constraint.alias("by_constraint"), "by_marker").where("by_constraint OR by_marker")
