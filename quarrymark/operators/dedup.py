"""Duplicate removal that never merges opposite statements.

Corpus-wide, only exact copies are merged, by hash and without collecting a group.  Near duplicates are judged inside one
ranked candidate list, where the list length bounds the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymark.config import RETRIEVAL
from quarrymark.functions.text import guard_negations, number_tokens
from quarrymark.operators.joins import attach
from quarrymark.session import durable


def exact_keepers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, keeper, copies): the smallest key of equal texts is kept, the others point to it."""
    rows = docs.select(key, F.sha1(F.col(text)).alias("digest"))
    groups = rows.groupBy("digest").agg(F.min(key).alias("keeper"), F.count(F.lit(1)).alias("copies"))
    return attach(rows, groups, ["digest"], count="copies").select(key, "digest", "keeper", "copies")


def with_guards(candidates: DataFrame, text: str = "text") -> DataFrame:
    """Word set and protected tokens (negations, numbers) of every candidate."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), 0))
    guard = F.concat_ws(
        "|", F.array_join(guard_negations(F.col(text)), ","), F.array_join(number_tokens(F.col(text)), ",")
    )
    return candidates.withColumn("words", words).withColumn("guard", F.sha1(guard))


def near_pairs(candidates: DataFrame, least: float = RETRIEVAL.near_jaccard) -> DataFrame:
    """Pairs of one candidate list that say the same: equal protected tokens and word Jaccard >= least.

    Lists are paired by guard and number of words alone; the words of a pair of documents are compared once, however many lists
    hold both.  ``candidates`` is read several times: a written table.
    """
    slim = candidates.select("qid", "guard", "item", "rank", F.size("words").alias("n"))
    a = slim.select("qid", "guard", *[F.col(c).alias(f"{c}_a") for c in ("item", "rank", "n")])
    b = slim.select("qid", "guard", *[F.col(c).alias(f"{c}_b") for c in ("item", "rank", "n")])
    close = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")
    listed = a.join(b, ["qid", "guard"]).where((F.col("rank_a") < F.col("rank_b")) & close).select("qid", "item_a", "item_b")
    words = candidates.select("item", "words").dropDuplicates(["item"])
    side = lambda tag: words.select(F.col("item").alias(f"item_{tag}"), F.col("words").alias(f"words_{tag}"))
    pairs = listed.select("item_a", "item_b").distinct().join(side("a"), "item_a").join(side("b"), "item_b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    counted = pairs.select("item_a", "item_b", shared.alias("shared"), (F.size("words_a") + F.size("words_b") - shared).alias("union"))
    jaccard = F.when(F.col("union") == 0, 1.0).otherwise(F.round(F.col("shared") / F.col("union"), 6))
    alike = counted.select("item_a", "item_b", jaccard.alias("jaccard")).where(F.col("jaccard") >= least)
    return listed.join(alike, ["item_a", "item_b"]).select("qid", "item_a", "item_b", "jaccard")


OPTIONAL = {"document": "long", "section": "string", "start": "long", "end": "long", "embedding": "array<double>"}


def duplicate_pairs(candidates: DataFrame, near: float, cosine: float, overlap: float) -> DataFrame:
    """(qid, item, other, other_rank, rule): a better ranked candidate of the list that says the same; rule ``touches`` marks spans
    that share characters without being the same."""
    side = lambda tag: candidates.select("qid", *[F.col(c).alias(f"{c}_{tag}") for c in candidates.columns if c != "qid"])
    a, b = side("a"), side("b")
    pairs = a.join(b, "qid").where("rank_a < rank_b")  # one ranked list of k items
    same_section = (F.col("document_a") == F.col("document_b")) & (F.col("section_a") == F.col("section_b"))
    shared = F.when(same_section, F.least("end_a", "end_b") - F.greatest("start_a", "start_b"))
    shorter = F.greatest(F.least(F.col("end_a") - F.col("start_a"), F.col("end_b") - F.col("start_b")), F.lit(1))
    union = F.size(F.array_union("words_a", "words_b"))
    alike = (union == 0) | (F.size(F.array_intersect("words_a", "words_b")) >= near * union)
    dot = F.aggregate(F.zip_with("embedding_a", "embedding_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rule = (
        F.when(F.col("digest_a") == F.col("digest_b"), "exact")
        .when((shared > 0) & (shared / shorter >= overlap), "overlap")
        .when((F.col("guard_a") == F.col("guard_b")) & alike & F.coalesce(dot >= cosine, F.lit(True)), "near")
        .when(shared > 0, "touches")
    )
    found = pairs.select("qid", F.col("item_b").alias("item"), F.col("item_a").alias("other"), F.col("rank_a").alias("other_rank"), rule.alias("rule"))
    return found.where("rule IS NOT NULL")


def greedy(
    candidates: DataFrame,
    near: float = RETRIEVAL.near_jaccard,
    cosine: float = RETRIEVAL.near_cosine,
    overlap: float = RETRIEVAL.overlap_merge,
) -> DataFrame:
    """First-kept-wins over each candidate list: (qid, item, rank, kept_item, rule, overlaps).

    Needs (qid, item, rank, digest, guard, words); optional columns add the span rule (document, section, start, end) and
    the cosine test (embedding).  A candidate is kept when none of the better ones that say the same is kept.  All lists are
    decided together, round by round: who has no open better twin is kept, whoever has a kept one goes.
    """
    full = candidates
    for name, kind in OPTIONAL.items():
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast(kind))
    slim = durable(full.select("qid", "item", "rank", "digest", "guard", "words", *OPTIONAL))
    pairs = durable(duplicate_pairs(slim, near, cosine, overlap))
    twins = pairs.where("rule <> 'touches'")
    state = slim.select("qid", "item", F.lit(None).cast("boolean").alias("kept"))
    undecided = True
    while undecided:
        others = state.select("qid", F.col("item").alias("other"), F.col("kept").alias("other_kept"))
        verdict = twins.join(others, ["qid", "other"]).groupBy("qid", "item").agg(
            F.bool_or(F.coalesce("other_kept", F.lit(False))).alias("gone"),
            F.bool_and(~F.coalesce("other_kept", F.lit(True))).alias("free"),
        )
        decided = F.when(F.col("gone").isNull() | F.col("free"), True).when(F.col("gone"), False)
        state = durable(
            state.join(verdict, ["qid", "item"], "left").select("qid", "item", F.coalesce("kept", decided).alias("kept"))
        )
        undecided = not state.where("kept IS NULL").isEmpty()
    kept = state.where("kept").select("qid", F.col("item").alias("other"))
    to_kept = pairs.join(kept, ["qid", "other"])
    order = F.struct((F.col("rule") != "exact").alias("later"), "other_rank")
    target = to_kept.where("rule <> 'touches'").groupBy("qid", "item").agg(F.min_by(F.struct("other", "rule"), order).alias("t"))
    # spans of two kept candidates that only touch are named on both sides
    touching = to_kept.where("rule = 'touches'").join(kept.withColumnRenamed("other", "item"), ["qid", "item"])
    both = touching.select("qid", "item", "other").union(touching.select("qid", F.col("other"), F.col("item")))
    overlaps = both.groupBy("qid", "item").agg(F.array_sort(F.collect_set("other")).alias("overlaps"))
    return (
        slim.select("qid", "item", "rank")
        .join(target, ["qid", "item"], "left")
        .join(overlaps, ["qid", "item"], "left")
        .select(
            "qid",
            "item",
            "rank",
            F.coalesce("t.other", "item").alias("kept_item"),
            F.coalesce("t.rule", F.lit("kept")).alias("rule"),
            F.coalesce("overlaps", F.array().cast("array<long>")).alias("overlaps"),
        )
    )


def overlapping_spans(spans: DataFrame, least: float = RETRIEVAL.overlap_merge) -> DataFrame:
    """Pairs of spans of one section that share characters, with the share of the shorter span.

    ``spans`` are windows of one document section in order, at a fixed step, so only neighbours within ``reach`` positions can
    overlap; the join is on (document, section, position) and stays linear in the number of windows.
    """
    reach = spans.agg(F.max("reach")).scalar()
    a = spans.select("document", "section", "pos", F.col("start").alias("start_a"), F.col("end").alias("end_a"))
    b = spans.select(
        "document",
        "section",
        F.col("pos").alias("pos_b"),
        F.col("start").alias("start_b"),
        F.col("end").alias("end_b"),
        F.explode(F.sequence(F.lit(1), reach)).alias("back"),
    ).withColumn("pos", F.col("pos_b") - F.col("back"))
    shared = F.least("end_a", "end_b") - F.greatest("start_a", "start_b")
    shorter = F.least(F.col("end_a") - F.col("start_a"), F.col("end_b") - F.col("start_b"))
    return (
        a.join(b, ["document", "section", "pos"])
        .withColumn("shared", shared)
        .where("shared > 0")
        .select(
            "document",
            "section",
            F.col("pos").alias("pos_a"),
            "pos_b",
            "shared",
            F.round(F.col("shared") / F.greatest(shorter, F.lit(1)), 6).alias("ratio"),
        )
        .withColumn("merge", F.col("ratio") >= least)
    )
