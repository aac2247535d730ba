"""Claims: selecting sentences that answer a need, checking them against evidence, citing and rendering them.

Everything starts from ranked lists, so a need brings at most k documents and four claims; one sentence is one row and is never
paired with sentences of other needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.functions import text as tx
from quarrymark.operators.rank import top_k

SUPPORTING = ("STRONG", "MODERATE")


def sentence_rows(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, pos, sentence, terms, numbers, negated), instruction-like sentences left out."""
    rows = docs.select(*keys, F.posexplode(tx.sentences(F.col(text))).alias("pos", "sentence"))
    return rows.where(~tx.is_instruction(F.col("sentence"))).select(
        *keys,
        "pos",
        "sentence",
        tx.terms(F.col("sentence")).alias("terms"),
        tx.number_tokens(F.col("sentence")).alias("numbers"),
        tx.is_negated(F.col("sentence")).alias("negated"),
    )


def query_weights(terms: DataFrame) -> DataFrame:
    """(qid, weights, total, top): positive idf of the distinct query terms; ``terms`` is (qid, term, idf)."""
    return terms.where("idf > 0").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("weights"),
        F.sum("idf").alias("total"),
        F.max("idf").alias("top"),
    )


def select(sentences: DataFrame, weights: DataFrame, least: float = 0.2, k: int = 4) -> DataFrame:
    """The k best sentences of a need.

    Relevance is the shared idf over the total; a sentence must share two terms (or all, when the need has fewer) or the most
    specific one.  Ties: better-ranked document, then position.
    """
    rows = sentences.join(weights, "qid")
    shared = F.filter("weights", lambda w: F.array_contains("terms", w["term"]))
    scored = rows.withColumn("shared", shared).where(F.size("shared") > 0)
    weight = F.aggregate("shared", F.lit(0.0), lambda a, w: a + w["idf"])
    anchor = F.exists("shared", lambda w: w["idf"] == F.col("top"))
    enough = F.size("shared") >= F.least(F.lit(2), F.size("weights"))
    kept = scored.withColumn("relevance", F.round(weight / F.col("total"), 4)).where(
        (F.col("relevance") >= least) & (enough | anchor)
    )
    return top_k(
        kept.drop("weights", "shared", "total", "top"),
        ["qid"],
        F.col("relevance").desc(),
        F.col("rank").asc(),
        F.col("doc_id").asc(),
        F.col("pos").asc(),
        k=k,
        name="claim",
    )


def premises(sentences: DataFrame) -> DataFrame:
    """Sentences, plus windows of two neighbouring sentences of one document."""
    nxt = sentences.select(
        "qid", "doc_id", (F.col("pos") - 1).alias("pos"), F.col("terms").alias("t2"), F.col("numbers").alias("n2"), F.col("negated").alias("g2")
    )
    pairs = sentences.join(nxt, ["qid", "doc_id", "pos"]).select(
        "qid",
        "doc_id",
        "pos",
        F.lit("window").alias("kind"),
        F.array_union("terms", "t2").alias("terms"),
        F.array_union("numbers", "n2").alias("numbers"),
        (F.col("negated") | F.col("g2")).alias("negated"),
    )
    single = sentences.select("qid", "doc_id", "pos", F.lit("sentence").alias("kind"), "terms", "numbers", "negated")
    return single.unionByName(pairs)


def align(claims: DataFrame, prem: DataFrame) -> DataFrame:
    """(qid, claim, doc_id, strength): how each evidence document of the need bears on each claim, by rules.

    Entailed: the premise has all terms and numbers and the same polarity.  Contradicted: it shares at least four fifths of the
    terms but other numbers or the other polarity.  Otherwise half of the terms make a weak link.
    """
    c = claims.select(
        "qid", "claim", F.col("terms").alias("ct"), F.col("numbers").alias("cn"), F.col("negated").alias("cg")
    )
    both = c.join(prem, "qid")
    n = F.size("ct")
    shared = F.size(F.array_intersect("ct", "terms"))
    nums_in = F.size(F.array_except("cn", "numbers")) == 0
    same = F.col("cg") == F.col("negated")
    entailed = (n > 0) & (shared == n) & nums_in & same
    clash = ((F.size("cn") > 0) & (F.size("numbers") > 0) & ~nums_in) | ~same
    contradicted = (n > 0) & (shared / n >= 0.8) & clash & (F.col("kind") == "sentence")
    level = (
        F.when(entailed & (F.col("kind") == "sentence"), 3).when(entailed, 2).when(contradicted, 1).otherwise(0)
    )
    overlap = F.when(n > 0, shared / n).otherwise(0.0)
    judged = both.select("qid", "claim", "doc_id", "pos", level.alias("level"), overlap.alias("overlap"))
    best = judged.groupBy("qid", "claim", "doc_id").agg(
        F.max("level").alias("level"),
        F.max("overlap").alias("overlap"),
        F.min_by("pos", F.struct(-F.col("level"), F.col("pos"))).alias("premise"),
    )
    strength = (
        F.when(F.col("level") == 3, "STRONG")
        .when(F.col("level") == 2, "MODERATE")
        .when(F.col("level") == 1, "CONTRADICTORY")
        .when(F.col("overlap") >= 0.5, "WEAK")
        .otherwise("NONE")
    )
    return best.select("qid", "claim", "doc_id", strength.alias("strength"), "premise", F.round("overlap", 6).alias("overlap"))


def verify(alignments: DataFrame, cited: DataFrame) -> DataFrame:
    """(qid, claim, status, counts): ``cited`` is (qid, claim, doc_id), the evidence the claim names."""
    rows = alignments.join(cited.withColumn("cited", F.lit(True)), ["qid", "claim", "doc_id"], "left")
    supports = F.col("strength").isin(*SUPPORTING)
    per = rows.groupBy("qid", "claim").agg(
        F.count_if(supports).alias("n_support"),
        F.count_if(F.col("strength") == "CONTRADICTORY").alias("n_contra"),
        F.count_if(F.col("strength") == "WEAK").alias("n_weak"),
        F.count_if(supports & F.col("cited").isNull()).alias("n_outside"),
    )
    status = (
        F.when((F.col("n_support") > 0) & (F.col("n_contra") > 0), "CONTRADICTED")
        .when(F.col("n_support") > 0, "SUPPORTED")
        .when(F.col("n_contra") > 0, "CONTRADICTED")
        .otherwise("UNSUPPORTED")
    )
    return per.select("qid", "claim", status.alias("status"), "n_support", "n_contra", "n_weak", "n_outside")


def action(status: Column, n_support: Column, planned: Column, left: Column, material: Column) -> Column:
    """What to do with a claim, first rule that applies."""
    return (
        F.when(status == "SUPPORTED", "keep")
        .when((status == "CONTRADICTED") & (n_support > 0), "present_conflict")
        .when(status == "PARTIALLY_SUPPORTED", "keep_atoms")
        .when(planned, "restore_facts")
        .when((status == "UNSUPPORTED") & (left > 0) & material, "retrieve")
        .otherwise("remove")
    )


def cite(alignments: DataFrame, cited: DataFrame, per_claim: int = 2) -> DataFrame:
    """At most two citations per claim: strong support first, evidence the claim names first, then document order."""
    rows = alignments.where(F.col("strength").isin(*SUPPORTING)).join(
        cited.withColumn("cited", F.lit(True)), ["qid", "claim", "doc_id"], "left"
    )
    return top_k(
        rows,
        ["qid", "claim"],
        F.when(F.col("strength") == "STRONG", 0).otherwise(1).asc(),
        F.col("cited").desc_nulls_last(),
        F.col("doc_id").asc(),
        k=per_claim,
        name="citation",
    ).select("qid", "claim", "citation", "doc_id", "strength", "premise")


def consistency(claims: DataFrame) -> DataFrame:
    """Pairs of claims of one need (at most four claims) with the same terms but other numbers or polarity."""
    side = lambda s: claims.select("qid", *[F.col(c).alias(f"{c}_{s}") for c in ("claim", "terms", "numbers", "negated")])
    shared = F.size(F.array_intersect("terms_a", "terms_b"))
    same = (shared == F.size("terms_a")) & (shared == F.size("terms_b")) & (shared > 0)
    differs = (F.col("numbers_a") != F.col("numbers_b")) | (F.col("negated_a") != F.col("negated_b"))
    return side("a").join(side("b"), "qid").where("claim_a < claim_b").where(same & differs).select("qid", "claim_a", "claim_b")


def atoms(text: Column) -> Column:
    """Clauses of a claim: split at `and`, `but`, `while` or a semicolon when both sides keep at least two words."""
    parts = F.split(text, r"\s*;\s*|\s+(?:and|but|while)\s+")
    long = F.forall(parts, lambda p: F.size(F.split(F.trim(p), r"\s+")) >= 2)
    return F.when((F.size(parts) > 1) & long, parts).otherwise(F.array(text))


def render(facts: DataFrame) -> DataFrame:
    """One answer text per need: facts with their citation keys, conflicts announced, gaps named."""
    w = F.array_sort(F.collect_list(F.struct("claim", "line")))
    body = facts.groupBy("qid").agg(F.array_join(F.transform(w, lambda x: x["line"]), " ").alias("answer"))
    return body


def numbered_fact_keys(claims: DataFrame, key: Column) -> DataFrame:
    """Position of a claim among the claims with its fact key, for one-to-one pairing."""
    w = Window.partitionBy("qid", "fact").orderBy("claim")
    return claims.withColumn("fact", key).withColumn("n", F.row_number().over(w))


def diff_by_fact(old: DataFrame, new: DataFrame) -> DataFrame:
    """kept / modified / added / retracted: removed and added claims that share a fact key are one modification."""
    gone = old.join(new.select("qid", "sentence"), ["qid", "sentence"], "left_anti")
    fresh = new.join(old.select("qid", "sentence"), ["qid", "sentence"], "left_anti")
    kept = new.join(old.select("qid", "sentence"), ["qid", "sentence"], "left_semi").select("qid", F.lit("kept").alias("change"))
    a = numbered_fact_keys(gone, F.col("fact")).select("qid", "fact", "n", F.lit(True).alias("was"))
    b = numbered_fact_keys(fresh, F.col("fact")).select("qid", "fact", "n", F.lit(True).alias("now"))
    change = F.when(F.col("was") & F.col("now"), "modified").when(F.col("was"), "retracted").otherwise("added")
    return kept.unionByName(a.join(b, ["qid", "fact", "n"], "full_outer").select("qid", change.alias("change")))
