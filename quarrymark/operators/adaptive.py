"""Adaptive retrieval: analysing a need, choosing a strategy, judging the evidence, deciding when to stop.

A loop that searches again with a larger k is one ranked list cut at several depths: the list is computed once for the largest k
and every iteration is an aggregate over its prefix, for all needs at the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.config import ADAPTIVE

# First k per complexity, action priors.
INITIAL_K = {"SIMPLE": 3, "MODERATE": 5, "COMPLEX": 5, "MULTI_HOP": 5}
PRIORS = {
    "hop": 0.7, "requirement_query": 0.6, "contradiction_search": 0.5, "relax_filter": 0.5, "expand_k": 0.4, "rerank": 0.4,
}


def analyse_needs(asked: DataFrame, known: DataFrame, bridges: DataFrame, temporal: DataFrame) -> DataFrame:
    """Per need: term counts, share of unknown terms, rare terms, complexity.

    ``asked`` (qid, term), ``known`` (term, idf), ``bridges`` (qid, term), ``temporal`` (qid, kind, explicit).
    """
    content = asked.where(~F.col("term").rlike(r"^\d+$")).join(known, "term", "left")
    per = content.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_content"),
        F.count_if(F.col("idf").isNull()).alias("n_oov"),
        F.count_if(F.col("idf") >= ADAPTIVE.rare_idf).alias("n_rare"),
        F.round(F.max("idf"), 6).alias("max_idf"),
    )
    hops = bridges.groupBy("qid").agg(F.count(F.lit(1)).alias("n_bridge"))
    rows = temporal.join(per, "qid", "left").join(hops, "qid", "left")
    n = F.coalesce("n_content", F.lit(0))
    oov = F.round(F.when(n > 0, F.col("n_oov") / n).otherwise(0.0), 3)
    moderate = (F.col("kind") != "none") | (F.col("oov_ratio") >= ADAPTIVE.oov_ratio) | (n <= 1) | (n > 8)
    complexity = (
        F.when(F.col("n_bridge") > 0, "MULTI_HOP")
        .when(F.col("comparison"), "COMPLEX")
        .when(moderate, "MODERATE")
        .otherwise("SIMPLE")
    )
    return rows.withColumn("oov_ratio", oov).withColumn("complexity", complexity)


def strategy(
    complexity: Column,
    exact_id: Column,
    filtered: Column,
    oov: Column,
    dense_available: Column,
    left_ms: Column,
    routing: bool = True,
    tight_ms: float = 150.0,
) -> Column:
    """Retrieval strategy, first rule that applies; without a vector index everything that needs one becomes lexical."""
    if not routing:
        return F.lit("HYBRID")
    picked = (
        F.when(left_ms < tight_ms, "LEXICAL")
        .when(complexity == "MULTI_HOP", "MULTI_HOP")
        .when(exact_id & ~filtered & complexity.isin("SIMPLE", "MODERATE"), "LEXICAL")
        .when(filtered, "FILTERED")
        .when(oov >= ADAPTIVE.oov_ratio, "SEMANTIC")
        .when(complexity == "COMPLEX", "ITERATIVE")
        .when(complexity == "SIMPLE", "LEXICAL")
        .otherwise("HYBRID")
    )
    return F.when(dense_available, picked).otherwise("LEXICAL")


def first_k(complexity: Column) -> Column:
    table = F.create_map(*[x for k, v in INITIAL_K.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, complexity)


def expansions(asked: DataFrame, known: DataFrame, limit: int = 3, at_least: int = 4) -> DataFrame:
    """(qid, term, variant, n): index terms that extend or shorten a term the index does not know, at most ``limit`` per need.

    Prefixes are spelled out on one side and joined by equality, so only true variants meet, however common a stem is.
    """
    from quarrymark.operators.rank import top_k

    def prefixes(column: str, longest: Column) -> Column:
        return F.transform(F.sequence(F.lit(at_least), longest), lambda n: F.left(F.col(column), n))

    lost = asked.join(known, "term", "left_anti").where(F.length("term") >= at_least)
    vocab = known.where(F.length("term") >= at_least).select(F.col("term").alias("variant"), "idf")
    longer = vocab.select("variant", "idf", F.explode(prefixes("variant", F.length("variant"))).alias("term"))
    shorter = lost.select("qid", "term", F.explode(prefixes("term", F.length("term"))).alias("variant"))
    found = (
        lost.join(longer, "term")
        .where(~F.col("term").rlike(r"^\d+$"))
        .select("qid", "term", "variant", "idf")
        .unionByName(shorter.join(vocab, "variant").where(~F.col("variant").rlike(r"^\d+$")).select("qid", "term", "variant", "idf"))
    )
    order = [F.col("idf").asc(), F.col("term").asc(), F.col("variant").asc()]
    return top_k(found, ["qid"], *order, k=limit, name="n").select("qid", "term", "variant", "n")


def anchors(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, terms, anchor): the most specific term of a need (unknown terms are the most specific, ties: first said); a need of
    one term has none.  ``asked`` is (qid, pos, term)."""
    rows = asked.join(known, "term", "left").withColumn("w", F.coalesce("idf", F.lit(float("inf"))))
    best = F.max_by(F.when(~F.col("term").rlike(r"^\d+$"), F.col("term")), F.struct(
        F.when(F.col("term").rlike(r"^\d+$"), -1.0).otherwise(F.col("w")), -F.col("pos")))
    per = rows.groupBy("qid").agg(F.collect_set("term").alias("terms"), best.alias("anchor"))
    return per.withColumn("anchor", F.when(F.size("terms") > 1, F.col("anchor")))


def judge(evidence: DataFrame, needs: DataFrame, coverage: float = ADAPTIVE.coverage) -> DataFrame:
    """(qid, doc_id, rank, coverage, supports): evidence has (qid, doc_id, rank, e) with e its terms."""
    rows = evidence.join(needs, "qid")
    share = F.round(F.size(F.array_intersect("terms", "e")) / F.size("terms"), 6)
    has_anchor = F.col("anchor").isNull() | F.array_contains("e", F.col("anchor"))
    return rows.withColumn("coverage", share).withColumn("supports", (F.col("coverage") >= coverage) & has_anchor)


def iterations(judged: DataFrame, needs: DataFrame, schedule: tuple[int, ...] = ADAPTIVE.schedule) -> DataFrame:
    """(qid, iteration, k, met, quality, gain, stop): one row per depth of the schedule.

    Stop reasons in order: sufficient, no results, iteration limit, result limit, no expected gain.
    """
    ks = F.array(*[F.lit(k) for k in schedule])
    grid = needs.select("qid", F.posexplode(ks).alias("i", "k"))
    seen = grid.join(judged.select("qid", "rank", "coverage", "supports"), "qid", "left")
    inside = F.col("rank") <= F.col("k")
    per = seen.groupBy("qid", "i", "k").agg(
        F.count_if(inside).alias("n_results"),
        F.coalesce(F.bool_or(F.col("supports") & inside), F.lit(False)).alias("met"),
        F.coalesce(F.max(F.when(inside, F.col("coverage"))), F.lit(0.0)).alias("quality"),
    )
    w = Window.partitionBy("qid").orderBy("i")
    met = F.col("met").cast("int")
    gain = F.round(
        met - F.coalesce(F.lag(met).over(w), F.lit(0)) + 0.5 * (F.col("quality") - F.coalesce(F.lag("quality").over(w), F.lit(0.0))), 4
    )
    rows = per.withColumn("gain", gain)
    stop = (
        F.when(F.col("met"), "sufficient_evidence")
        .when(F.col("n_results") == 0, "no_results")
        .when(F.col("i") + 1 >= ADAPTIVE.max_iterations, "iteration_limit")
        .when(F.col("n_results") >= ADAPTIVE.max_results, "query_limit")
        .when((F.col("i") > 0) & (F.col("gain") < ADAPTIVE.min_gain), "no_expected_gain")
    )
    return rows.select("qid", (F.col("i") + 1).alias("iteration"), "k", "met", "quality", "gain", stop.alias("stop"))


def stopping_point(steps: DataFrame) -> DataFrame:
    """First iteration of every need that gives a reason to stop."""
    return steps.where(F.col("stop").isNotNull()).groupBy("qid").agg(
        F.min("iteration").alias("iteration"),
        F.min_by("stop", "iteration").alias("stop"),
        F.min_by("quality", "iteration").alias("quality"),
    )


def expected_gain(action: Column, open_share: Column) -> Column:
    table = F.create_map(*[x for k, v in PRIORS.items() for x in (F.lit(k), F.lit(v))])
    return F.round(open_share * F.coalesce(F.try_element_at(table, action), F.lit(0.3)), 4)


def need_status(n: Column, met: Column, conflicts: Column) -> Column:
    return (
        F.when(conflicts > 0, "CONTRADICTORY")
        .when((n > 0) & (met == n), "SUFFICIENT")
        .when(met > 0, "PARTIAL")
        .otherwise("INSUFFICIENT")
    )


def resolve_conflicts(sides: DataFrame, keys: list[str], gap: float = ADAPTIVE.authority_gap) -> DataFrame:
    """(keys, n, rule): how sources that disagree are reconciled: an agreed successor, else a clear authority gap, else not.

    ``sides`` has (keys, authority, superseded) with one row per source.
    """
    per = sides.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("superseded").alias("n_old"),
        F.max("authority").alias("top"),
        F.min("authority").alias("low"),
    )
    second = sides.join(per.select(*keys, "top"), keys).where(F.col("authority") < F.col("top")).groupBy(*keys).agg(
        F.max("authority").alias("second")
    )
    rows = per.join(second, keys, "left").where("n > 1")
    rule = (
        F.when((F.col("n_old") > 0) & (F.col("n_old") < F.col("n")), "version_supersession")
        .when(F.round(F.col("top") - F.col("second"), 6) >= gap, "authority")
        .otherwise("unresolved")
    )
    return rows.select(*keys, "n", rule.alias("rule"))


def final_evidence(judged: DataFrame, group: str, cap: int = ADAPTIVE.per_document, k: int = ADAPTIVE.final_k) -> DataFrame:
    """Supporters first, then by rank; at most ``cap`` per source and ``k`` in all."""
    from quarrymark.operators.rank import top_k

    order = [F.col("supports").desc(), F.col("rank").asc()]
    capped = top_k(judged, ["qid", group], *order, k=cap, name="in_group")
    return top_k(capped, ["qid"], *order, k=k, name="final_rank")
