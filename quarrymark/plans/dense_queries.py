"""Vector search with the label prototypes as the query batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.operators import dense
from quarrymark.plans.registry import named

PROTO = (
    "means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS v FROM (SELECT label, unnest(embedding) AS x, "
    "generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL), "
    "norms AS (SELECT label, sqrt(sum(v * v)) AS n FROM means GROUP BY label), "
    "protos AS (SELECT m.label AS qid, list(m.v / n.n ORDER BY m.pos) AS vec FROM means m JOIN norms n USING (label) GROUP BY m.label), "
    "sims AS (SELECT p.qid, e.vec_id, e.label, round(list_inner_product(CAST(e.embedding AS DOUBLE[]), p.vec), 6) AS score "
    "FROM embeddings e CROSS JOIN protos p)"
)


def prototypes(t):
    return dense.prototypes(t.embeddings).select(F.col("label").alias("qid"), "embedding")


@named(
    "dense_topk",
    f"WITH {PROTO} SELECT qid, vec_id, score, rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims) WHERE rank <= 10",
)
def dense_topk(t):
    return dense.search(t.embeddings, prototypes(t), k=10)


@named(
    "dense_min_similarity",
    f"WITH {PROTO} SELECT qid, vec_id, score, rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims WHERE score >= 0.3) WHERE rank <= 50",
)
def dense_min_similarity(t):
    return dense.search(t.embeddings, prototypes(t), k=50, least=0.3)


@named(
    "cross_intent_relevance",
    f"WITH {PROTO}, top AS (SELECT qid // 3 AS uid, vec_id FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims) WHERE rank <= 10), "
    "cand AS (SELECT DISTINCT uid, vec_id FROM top), s AS (SELECT c.uid, sims.qid, sims.vec_id, sims.score FROM sims JOIN cand c ON c.uid = sims.qid // 3 AND c.vec_id = sims.vec_id), "
    "best AS (SELECT uid, vec_id, max(score) AS best_score, arg_min(qid, (-score, qid)) AS best_qid FROM s GROUP BY uid, vec_id) "
    "SELECT uid, s.qid, vec_id, s.score, b.best_qid, b.best_score FROM s JOIN best b USING (uid, vec_id)",
)
def cross_intent_relevance(t):
    """Three labels are one request: its lists' union scored against its needs, with the need each candidate fits best."""
    queries = prototypes(t).withColumn("uid", F.floor(F.col("qid") / 3))
    found = dense.search(t.embeddings, queries, k=10).select(F.floor(F.col("qid") / 3).alias("uid"), "vec_id").distinct()
    scores = dense.relevance(found.join(t.embeddings.select("vec_id", "embedding"), "vec_id"), queries)
    best = scores.groupBy("uid", "vec_id").agg(
        F.max("score").alias("best_score"), F.max_by("qid", F.struct("score", -F.col("qid"))).alias("best_qid")
    )
    return scores.join(best, ["uid", "vec_id"]).select("uid", "qid", "vec_id", "score", "best_qid", "best_score")


@named(
    "centroid_classify",
    f"WITH {PROTO}, o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, qid) AS rk FROM sims) "
    "SELECT vec_id, max(label) AS label, max(qid) FILTER (WHERE rk = 1) AS predicted, "
    "round(least(1.0, greatest(0.0, 0.5 + 5.0 * (max(score) FILTER (WHERE rk = 1) - max(score) FILTER (WHERE rk = 2)))), 3) AS confidence FROM o GROUP BY vec_id",
)
def centroid_classify(t):
    """Nearest prototype; the margin to the second one is the confidence."""
    two = dense.nearest(t.embeddings, prototypes(t), n=2)
    pick = two.groupBy("vec_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("qid"))).cast("int").alias("predicted"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
    )
    margin = F.lit(0.5) + 5.0 * (F.col("s1") - F.col("s2"))
    return t.embeddings.select("vec_id", "label").join(pick, "vec_id").select(
        "vec_id", "label", "predicted", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin)), 3).alias("confidence")
    )
