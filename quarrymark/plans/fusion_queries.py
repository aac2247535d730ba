"""Hybrid retrieval, fusion of several needs, duplicate removal in candidate lists.

Three consecutive passages form one request; each passage is one of its needs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.operators import dedup, dense, fusion, lexical
from quarrymark.operators.rank import fuse_ranks, rrf_top, top_k
from quarrymark.plans.corpus_queries import texts_of
from quarrymark.plans.lexical_queries import passages
from quarrymark.plans.registry import named
from quarrymark.plans.sql_parts import BM25, ranked, sql_terms
from quarrymark.session import written


def request_lists(t, k: int = 10):
    """(uid, intent, intent_ord, item, section, score, rank)."""
    hits = lexical.bm25_top(t.index, passages(t), k=k)
    return hits.join(t.documents.select("doc_id", F.col("source").alias("section")), "doc_id").select(
        F.floor(F.col("qid") / 3).alias("uid"),
        F.col("qid").alias("intent"),
        F.pmod("qid", F.lit(3)).alias("intent_ord"),
        F.col("doc_id").alias("item"),
        "section",
        "score",
        "rank",
    )


LISTS = (
    f"{BM25}, {ranked(10)}, lists AS (SELECT r.qid // 3 AS uid, r.qid AS intent, r.qid % 3 AS intent_ord, r.doc_id AS item, "
    "d.source AS section, r.score, r.rank FROM ranked r JOIN documents d USING (doc_id))"
)


def _vec(table: str, key: str, name: str) -> str:
    """Signed feature hashing to 64 buckets, restated in SQL."""
    return (
        f"{name}_t AS (SELECT {key} AS k, {sql_terms('text')} AS toks FROM {table}), "
        f"{name}_f AS (SELECT k, unnest(toks) AS f FROM {name}_t UNION ALL SELECT k, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) FROM {name}_t), "
        f"{name}_c AS (SELECT k, ('0x' || substr(md5(f), 1, 8))::BIGINT AS code FROM {name}_f), "
        f"{name}_b AS (SELECT k, code % 64 AS bucket, sum(CASE WHEN (code // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM {name}_c GROUP BY ALL), "
        f"{name}_n AS (SELECT k, sqrt(sum(v * v)) AS norm FROM {name}_b GROUP BY k), "
        f"{name} AS (SELECT b.k, b.bucket, b.v / CASE WHEN n.norm > 0 THEN n.norm ELSE 1 END AS v FROM {name}_b b JOIN {name}_n n USING (k))"
    )


HASHED = (
    f"{_vec('documents', 'doc_id', 'dv')}, {_vec('benchmark', 'item_id', 'qv')}, "
    "vsims AS (SELECT q.k AS qid, d.k AS doc_id, round(sum(q.v * d.v), 6) AS score FROM qv q JOIN dv d USING (bucket) GROUP BY ALL), "
    "vranked AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM vsims) WHERE rank <= 50)"
)


def vector_lists(t, k: int = 50):
    docs = dense.hashed(t.documents)
    asked = dense.hashed(t.benchmark, key="item_id").withColumnRenamed("item_id", "qid")
    return dense.search(docs, asked, k=k, key="doc_id", sizes=(dense.counted(t.documents), dense.counted(t.benchmark)))


@named("hashing_embedder", f"WITH {HASHED} SELECT qid, doc_id, score, rank FROM vranked")
def hashing_embedder(t):
    return vector_lists(t)


RRF = (
    f"{BM25}, {ranked(50)}, {HASHED}, fused AS (SELECT coalesce(l.qid, d.qid) AS qid, coalesce(l.doc_id, d.doc_id) AS doc_id, l.rank AS left_rank, d.rank AS right_rank, "
    "round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + d.rank), 0), 12) AS rrf, least(l.rank, d.rank) AS best_rank "
    "FROM ranked l FULL OUTER JOIN vranked d ON d.qid = l.qid AND d.doc_id = l.doc_id), "
    "hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, best_rank, doc_id) AS rank FROM fused))"
)


def hybrid_lists(t, k: int = 10):
    return fused(lexical.bm25_top(t.index, passages(t), k=50), vector_lists(t), k)


def fused(lexical_list, vector_list, k: int = 10):
    return rrf_top(fuse_ranks(lexical_list, vector_list, ["qid", "doc_id"]), "qid", "doc_id", k=k)


@named("rrf_hybrid", f"WITH {RRF} SELECT qid, doc_id, left_rank, right_rank, rrf, rank FROM hybrid WHERE rank <= 10")
def rrf_hybrid(t):
    return hybrid_lists(t).select("qid", "doc_id", "left_rank", "right_rank", "rrf", "rank")


@named(
    "pool_merge_scores",
    f"WITH {RRF}, pool AS (SELECT qid, doc_id, 1.0 / (60 + rank) AS s, 'lexical' AS o FROM ranked UNION ALL SELECT qid, doc_id, 1.0 / (60 + rank), 'vector' FROM vranked "
    "UNION ALL SELECT qid, doc_id, 1.0 / (60 + rank), 'hybrid' FROM hybrid WHERE rank <= 10) "
    "SELECT qid, doc_id, round(sum(s), 9) AS score, count(*) AS n_lists FROM pool GROUP BY ALL",
)
def pool_merge_scores(t):
    """Union of several searches; the score of an item accumulates over all lists that found it."""
    lex = lexical.bm25_top(t.index, passages(t), k=50).select("qid", "doc_id", "rank")
    vec = vector_lists(t).select("qid", "doc_id", "rank")
    both = rrf_top(fuse_ranks(lex, vec, ["qid", "doc_id"]), "qid", "doc_id", k=10).select("qid", "doc_id", "rank")
    return (
        lex.unionByName(vec)
        .unionByName(both)
        .groupBy("qid", "doc_id")
        .agg(F.round(F.sum(F.lit(1.0) / (F.lit(60) + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("n_lists"))
    )


@named(
    "rerank_head",
    f"WITH {RRF}, head AS (SELECT h.qid, h.doc_id, h.rank, d.score FROM hybrid h LEFT JOIN vsims d ON d.qid = h.qid AND d.doc_id = h.doc_id WHERE h.rank <= 10) "
    "SELECT qid, doc_id, rank AS first_rank, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 5 THEN 0 ELSE 1 END, CASE WHEN rank <= 5 THEN -coalesce(score, 0) ELSE 0 END, rank) AS final_rank FROM head",
)
def rerank_head(t):
    """Re-order the first five by vector similarity; the tail keeps its order."""
    from pyspark.sql import Window

    docs = dense.hashed(t.documents)
    asked = dense.hashed(t.benchmark, key="item_id").withColumnRenamed("item_id", "qid")
    found = hybrid_lists(t).select("qid", "doc_id", F.col("rank").alias("first_rank"))
    q = asked.select("qid", F.col("embedding").alias("qv"))
    scored = found.join(docs, "doc_id").join(q, "qid").withColumn(
        "s", F.round(F.aggregate(F.zip_with("embedding", "qv", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y), 6)
    )
    head = F.col("first_rank") <= 5
    w = Window.partitionBy("qid").orderBy(
        F.when(head, 0).otherwise(1), F.when(head, -F.col("s")).otherwise(0.0), "first_rank"
    )
    return scored.select("qid", "doc_id", "first_rank", F.row_number().over(w).alias("final_rank"))


@named("fusion_concat", f"WITH {LISTS} SELECT * FROM (SELECT uid, intent, item, row_number() OVER (PARTITION BY uid ORDER BY intent_ord, rank) AS fused_rank FROM lists) WHERE fused_rank <= 8")
def fusion_concat(t):
    return fusion.concat_lists(request_lists(t)).select("uid", "intent", "item", "fused_rank")


@named(
    "fusion_global_score",
    f"WITH {LISTS}, best AS (SELECT uid, item, max(score) AS score FROM lists GROUP BY ALL) "
    "SELECT * FROM (SELECT uid, item, score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, item) AS fused_rank FROM best) WHERE fused_rank <= 8",
)
def fusion_global_score(t):
    return fusion.global_score(request_lists(t))


@named(
    "fusion_rrf",
    f"WITH {LISTS}, f AS (SELECT uid, item, round(sum(1.0 / (60 + rank)), 12) AS rrf, count(*) AS n_intents, arg_min(intent, (rank, intent_ord)) AS owner FROM lists GROUP BY ALL) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY rrf DESC, item) AS fused_rank FROM f) WHERE fused_rank <= 8",
)
def fusion_rrf(t):
    return fusion.rrf_lists(request_lists(t))


_PICKS = (
    f"{LISTS}, s1 AS (SELECT *, row_number() OVER (PARTITION BY uid, intent, section ORDER BY rank, item) AS in_section FROM lists), "
    "s2 AS (SELECT *, row_number() OVER (PARTITION BY uid, intent ORDER BY rank, item) AS turn FROM s1 WHERE in_section <= 2), "
    "s3 AS (SELECT *, CASE WHEN turn <= 2 THEN 0 ELSE 1 END AS phase, CASE WHEN turn <= 2 THEN turn ELSE rank END AS spot FROM s2), "
    "s4 AS (SELECT *, row_number() OVER (PARTITION BY uid, item ORDER BY phase, spot, intent_ord) AS copy FROM s3), "
    "firsts AS (SELECT uid, item, row_number() OVER (PARTITION BY uid ORDER BY phase, spot, intent_ord, item) AS place FROM s4 WHERE copy = 1), "
    "picks AS (SELECT s4.uid, s4.item, s4.intent, row_number() OVER (PARTITION BY s4.uid ORDER BY phase, spot, intent_ord, s4.item) AS pick FROM s4 JOIN firsts USING (uid, item) WHERE place <= 8 AND (phase = 0 OR copy = 1))"
)


@named("fusion_intent_aware", f"WITH {_PICKS} SELECT uid, item, intent, pick FROM picks")
def fusion_intent_aware(t):
    return fusion.intent_aware(request_lists(t))


@named(
    "intent_coverage",
    f"WITH {_PICKS}, k AS (SELECT DISTINCT uid, item FROM picks) SELECT l.uid, l.intent, count(k.item) AS n_selected, count(k.item) > 0 AS covered, count(k.item) >= least(count(*), 2) AS floor_met FROM lists l LEFT JOIN k USING (uid, item) GROUP BY l.uid, l.intent",
)
def intent_coverage(t):
    lists = request_lists(t)
    return fusion.intent_coverage(lists, fusion.intent_aware(lists))


@named(
    "collect_hits",
    f"WITH {LISTS} SELECT uid, item, string_agg(intent || ':' || rank, ',' ORDER BY intent_ord, intent, rank) AS hits, count(*) AS n_hits, count(DISTINCT intent) AS n_intents, min(rank) AS best_rank FROM lists GROUP BY uid, item",
)
def collect_hits(t):
    rows = fusion.collect_hits(request_lists(t))
    shown = F.transform("hits", lambda h: F.concat_ws(":", h["intent"].cast("string"), h["rank"].cast("string")))
    return rows.withColumn("hits", F.array_join(shown, ","))


@named(
    "collect_stats",
    f"WITH {LISTS}, p AS (SELECT uid, item, count(*) AS n, count(DISTINCT intent) AS i FROM lists GROUP BY ALL) "
    "SELECT uid, CAST(sum(n) AS BIGINT) AS input_hits, count(*) AS unique_items, count(*) FILTER (WHERE i > 1) AS cross_intent_duplicates FROM p GROUP BY uid",
)
def collect_stats(t):
    return fusion.collect_stats(request_lists(t))


@named(
    "section_cap",
    f"WITH {LISTS} SELECT * FROM (SELECT uid, intent, item, section, rank, row_number() OVER (PARTITION BY intent, section ORDER BY rank) AS rank_in_group FROM lists) WHERE rank_in_group <= 2",
)
def section_cap(t):
    rows = fusion.capped(request_lists(t), ["intent", "section"], cap=2)
    return rows.select("uid", "intent", "item", "section", "rank", "rank_in_group")


@named(
    "per_source_cap",
    "SELECT * FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3",
)
def per_source_cap(t):
    """The three longest documents of every source: a source of any size sends three rows per task."""
    slim = t.documents.select("source", "doc_id", "n_chars")
    return top_k(slim, ["source"], F.col("n_chars").desc(), F.col("doc_id").asc(), k=3)


@named(
    "related_same_section",
    f"WITH {LISTS}, u AS (SELECT DISTINCT uid, section, item FROM lists) SELECT a.uid, a.section, a.item AS source, b.item AS target FROM u a JOIN u b ON a.uid = b.uid AND a.section = b.section AND a.item < b.item",
)
def related_same_section(t):
    return fusion.same_section(request_lists(t).select("uid", "section", "item").distinct())


# --- duplicates -------------------------------------------------------------------------------------------------


@named(
    "dedup_exact",
    "SELECT doc_id, sha1(text) AS digest, min(doc_id) OVER (PARTITION BY sha1(text)) AS keeper, count(*) OVER (PARTITION BY sha1(text)) AS copies FROM documents",
)
def dedup_exact(t):
    return dedup.exact_keepers(t.documents)


@named(
    "alias_join",
    f"WITH {LISTS}, k AS (SELECT doc_id AS item, min(doc_id) OVER (PARTITION BY sha1(text)) AS keeper FROM documents) "
    "SELECT l.uid, k.keeper AS item, count(*) AS n_hits, count(DISTINCT l.item) AS n_aliases, min(l.rank) AS best_rank FROM lists l JOIN k USING (item) GROUP BY ALL",
)
def alias_join(t):
    """Hits on copies count for the kept document."""
    lists = request_lists(t)
    alias = dedup.exact_keepers(t.documents).select(F.col("doc_id").alias("item"), "keeper")
    return (
        lists.join(alias, "item")
        .groupBy("uid", F.col("keeper").alias("k"))
        .agg(
            F.count(F.lit(1)).alias("n_hits"), F.countDistinct("item").alias("n_aliases"), F.min("rank").alias("best_rank")
        )
        .withColumnRenamed("k", "item")
    )


def candidate_lists(t, k: int = 50):
    """(qid, item, rank, digest, words, guard) of the lexical candidates; every document is analysed once."""
    hits = written(lexical.bm25_top(t.index, passages(t), k=k).select("qid", "doc_id", "rank"), "candidates")
    features = dedup.with_guards(texts_of(t, hits)).select("doc_id", F.sha1("text").alias("digest"), "words", "guard")
    return hits.join(features, "doc_id").withColumnRenamed("doc_id", "item")


_GUARD = (
    "list_sort(list_distinct(regexp_extract_all(lower(d.text), '\\b(?:no|not|never|nor|none|cannot|without|except|unless|neither)\\b|n''t\\b')))::VARCHAR "
    "|| list_sort(list_distinct(regexp_extract_all(d.text, '\\d+(?:[.,]\\d+)*')))::VARCHAR"
)


@named(
    "dedup_near_pairs",
    f"WITH {BM25}, {ranked(50)}, c AS (SELECT r.qid, r.doc_id AS item, r.rank, list_distinct(regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}_]+')) AS words, {_GUARD} AS guard FROM ranked r JOIN documents d USING (doc_id)), "
    "j AS (SELECT a.qid, a.item AS item_a, b.item AS item_b, a.words AS wa, b.words AS wb FROM c a JOIN c b ON a.qid = b.qid AND a.guard = b.guard AND a.rank < b.rank "
    "AND least(len(a.words), len(b.words)) >= 0.9 * greatest(len(a.words), len(b.words))), "
    "s AS (SELECT qid, item_a, item_b, round(len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))), 6) AS jaccard FROM j) SELECT * FROM s WHERE jaccard >= 0.9",
)
def dedup_near_pairs(t):
    return dedup.near_pairs(written(candidate_lists(t), "candidate-words"))


@named("dedup_greedy")
def dedup_greedy(t):
    return dedup.greedy(candidate_lists(t)).drop("overlaps")
