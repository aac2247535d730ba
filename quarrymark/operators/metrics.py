"""Ranking, evidence and answer metrics.  Nothing to measure gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymark.operators.stats import ratio


def ideal_gain(n: Column) -> Column:
    """Best possible discounted gain of n relevant items."""
    ranks = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ranks, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))


def ranking(run: DataFrame, gold: DataFrame, queries: DataFrame, k: int, key: str = "qid", item: str = "doc_id") -> DataFrame:
    """Per query: recall@k, precision@k, success@k, reciprocal rank and nDCG@k; all NULL without gold.

    ``run`` has (key, item, rank).  A repeated item counts at its first rank.
    """
    first = run.where(F.col("rank") <= k).groupBy(key, item).agg(F.min("rank").alias("rank"))
    wanted = gold.select(key, item).distinct()
    n_gold = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("n_gold"))
    hits = first.join(wanted, [key, item], "left_semi").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.min("rank").alias("best"),
        F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"),
    )
    rows = queries.select(key).join(n_gold, key, "left").join(hits, key, "left")
    n_hits = F.coalesce("n_hits", F.lit(0))
    has = F.col("n_gold").isNotNull()
    ideal = ideal_gain(F.least("n_gold", F.lit(k)))
    return rows.select(
        key,
        F.coalesce("n_gold", F.lit(0)).alias("n_gold"),
        F.when(has, F.round(n_hits / F.col("n_gold"), 6)).alias("recall"),
        F.when(has, F.round(n_hits / F.lit(k), 6)).alias("precision"),
        F.when(has, (n_hits > 0).cast("int")).alias("success"),
        F.when(has, F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6)).alias("mrr"),
        F.when(has, F.round(F.least(F.lit(1.0), F.coalesce("gain", F.lit(0.0)) / ideal), 6)).alias("ndcg"),
    )


def needed(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Rows once for every size n in 1..most that ``sizes`` asks for."""
    every = F.explode(F.array(*[F.lit(n) for n in range(1, most + 1)]))
    return rows.select("*", every.alias("n")).join(sizes.select("n").distinct(), "n", "left_semi")


def containing(docs: DataFrame, passages: DataFrame, width: int = 5) -> DataFrame:
    """(qid, doc_id) of every document that contains a passage character for character; an empty passage is in none.

    Interior words of a contained passage are whole words of the document, so its first up to ``width`` interior words are looked
    up as a run.  A passage of one or two words has none; its first up to three characters are looked up instead.  Both are
    hash joins on keys that the passages ask for, and the text comparison confirms what they find.
    """
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"[\p{L}\p{N}_]+"), 0)
    asked = passages.select("qid", "query", words("query").alias("ws")).where("query <> ''")
    inner = F.size("ws") - 2
    by_words = asked.where(inner > 0).withColumn("n", F.least(F.lit(width), inner))
    by_words = by_words.select("qid", "query", "n", F.array_join(F.slice("ws", F.lit(2), F.col("n")), " ").alias("gram"))
    by_letters = asked.where(inner <= 0).select("qid", "query", F.substring("query", 1, 3).alias("gram"))
    by_letters = by_letters.withColumn("n", F.length("gram"))

    def places(length):
        return F.sequence(F.lit(1), F.greatest(length - F.col("n") + 1, F.lit(1)))

    texts = docs.select("doc_id", "text")
    runs = F.transform(places(F.size("ws")), lambda i: F.array_join(F.slice(F.col("ws"), i, F.col("n")), " "))
    word_grams = needed(texts.select("doc_id", words("text").alias("ws")), by_words, width).select(
        "doc_id", "n", F.explode(F.array_distinct(runs)).alias("gram")
    )
    letters = F.transform(places(F.length("text")), lambda i: F.substring(F.col("text"), i, F.col("n")))
    letter_grams = needed(texts, by_letters, 3).select("doc_id", "n", F.explode(F.array_distinct(letters)).alias("gram"))
    found = word_grams.join(by_words, ["n", "gram"]).unionByName(letter_grams.join(by_letters, ["n", "gram"]))
    candidates = found.select("qid", "doc_id", "query")
    return candidates.join(texts, "doc_id").where(F.contains("text", "query")).select("qid", "doc_id").distinct()


def list_evidence(run: DataFrame, gold: DataFrame, key: str = "qid", item: str = "doc_id") -> DataFrame:
    """Evidence recall and precision, source diversity; ``run`` also carries (source, bad)."""
    marked = run.join(gold.select(key, item).distinct().withColumn("good", F.lit(True)), [key, item], "left")
    n_gold = gold.select(key, item).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_gold"))
    per = marked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("good").alias("n_good"),
        F.countDistinct("source").alias("n_sources"),
        F.max(F.coalesce(F.col("bad"), F.lit(0))).alias("contradictory"),
    )
    return per.join(n_gold, key, "left").select(
        key,
        ratio(F.col("n_good"), F.col("n_gold")).alias("evidence_recall"),
        F.when(F.col("n_gold").isNotNull(), ratio(F.col("n_good"), F.col("n"))).alias("evidence_precision"),
        ratio(F.col("n_sources"), F.col("n")).alias("diversity"),
        "contradictory",
    )


def mean_pairwise(items: DataFrame, key: str, item: str, vector: str) -> DataFrame:
    """Mean cosine over the pairs of one short list (a top-k list, so k bounds the pairs)."""
    a = items.select(key, F.col(item).alias("a"), F.col(vector).alias("va"))
    b = items.select(key, F.col(item).alias("b"), F.col(vector).alias("vb"))
    dot = F.aggregate(
        F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return a.join(b, key).where("a < b").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(dot), 6).alias("redundancy")
    )


def error_labels(rules: list[tuple[str, Column]]) -> Column:
    """All labels whose rule holds, in rule order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules]))


def difficulty(points: Column) -> Column:
    return F.when(points == 0, "EASY").when(points == 1, "MEDIUM").when(points <= 3, "HARD").otherwise("VERY_HARD")
