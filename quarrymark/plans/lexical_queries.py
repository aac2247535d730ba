"""Lexical index statistics and BM25 over the documents, asked with every benchmark passage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.operators import lexical
from quarrymark.operators.rank import top_k
from quarrymark.plans.registry import named
from quarrymark.plans.sql_parts import BM25, DOC_TERMS, IDF, POSTINGS, QTERMS, SCORES, STATS, ranked, sql_terms
from quarrymark.sources.tables import spread


def passages(t):
    return t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@named(
    "tok_counts",
    f"WITH {DOC_TERMS} SELECT doc_id, len(toks) AS n_terms, len(list_distinct(toks)) AS n_distinct FROM doc_terms",
)
def tok_counts(t):
    tokens = spread(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", lexical.analyse(F.col("text")).alias("toks"))
    return tokens.select(
        "doc_id", F.size("toks").alias("n_terms"), F.size(F.array_distinct("toks")).alias("n_distinct")
    )


@named("term_freq", f"WITH {POSTINGS} SELECT doc_id, term, tf FROM posts")
def term_freq(t):
    return t.index.postings().select("doc_id", "term", "tf")


@named("doc_freq", f"WITH {POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posts GROUP BY term")
def doc_freq(t):
    return t.index.frequencies()


@named("idf_table", f"WITH {POSTINGS}, {STATS}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_table(t):
    return t.index.with_idf().select("term", "df", F.round("idf", 6).alias("idf"))


@named(
    "corpus_stats",
    f"WITH {POSTINGS}, {STATS} SELECT s.n AS n_docs, round(s.avgdl, 6) AS avg_len, "
    "(SELECT count(DISTINCT term) FROM posts) AS vocabulary, (SELECT CAST(sum(tf) AS BIGINT) FROM posts) AS occurrences FROM stats s",
)
def corpus_stats(t):
    counts = t.index.frequencies()
    return counts.agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("cf").alias("occurrences")).select(
        t.index.size().alias("n_docs"),
        F.round(t.index.mean_length(), 6).alias("avg_len"),
        "vocabulary",
        "occurrences",
    )


@named("bm25_topk", f"WITH {BM25}, {ranked(10)} SELECT qid, doc_id, score, rank FROM ranked")
def bm25_topk(t):
    return lexical.bm25_top(t.index, passages(t))


@named(
    "bm25_filtered_topk",
    f"WITH {BM25}, kept AS (SELECT s.* FROM scores s JOIN documents d USING (doc_id) WHERE d.lang = 'en'), "
    f"{ranked(10, 'kept')} SELECT qid, doc_id, score, rank FROM ranked",
)
def bm25_filtered_topk(t):
    english = t.documents.where(F.col("lang") == "en")
    return lexical.bm25_top(t.index, passages(t), only=english)


@named(
    "bm25_rare_terms",
    f"WITH {POSTINGS}, {STATS}, {IDF}, qa AS (SELECT DISTINCT item_id AS qid, unnest({sql_terms('text')}) AS term FROM benchmark), "
    "qterms AS (SELECT qid, term FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY idf DESC, term) AS n FROM qa JOIN idf USING (term)) WHERE n <= 3), "
    f"{SCORES}, {ranked(10)} SELECT qid, doc_id, score, rank FROM ranked",
)
def bm25_rare_terms(t):
    """The three rarest known terms of every passage as a query, answered by the blocks that can still reach the ten best."""
    known = lexical.query_terms(passages(t)).join(t.index.with_idf().select("term", "idf"), "term")
    rare = top_k(known, ["qid"], F.col("idf").desc(), F.col("term").asc(), k=3)
    asked = rare.groupBy("qid").agg(F.array_join(F.collect_list("term"), " ").alias("query"))  # three terms
    return t.index.search(asked)


@named(
    "bm25_positive_only",
    f"WITH {BM25} SELECT b.item_id AS qid, count(s.doc_id) AS n_scored, max(s.score) AS best FROM benchmark b "
    "LEFT JOIN scores s ON s.qid = b.item_id AND s.score > 0 GROUP BY b.item_id",
)
def bm25_positive_only(t):
    scored = lexical.bm25_scores(t.index, passages(t))
    summary = scored.groupBy("qid").agg(F.count(F.lit(1)).alias("n_scored"), F.max("score").alias("best"))
    return (
        passages(t)
        .select("qid")
        .join(summary, "qid", "left")
        .select("qid", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), "best")
    )


# Every passage asks: documents with its two rarest-spelled terms (all) and any of the remaining terms.
_NEEDS = (
    f"needs AS (SELECT item_id AS need_id, list_sort(list_distinct({sql_terms('text')})) AS ts FROM benchmark), "
    "flat AS (SELECT need_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM needs)"
)


def passage_needs(t):
    sorted_terms = F.array_sort(lexical.terms(F.col("text")))
    return t.benchmark.select(F.col("item_id").alias("need_id"), sorted_terms.alias("ts")).select(
        "need_id",
        F.slice("ts", 1, 2).alias("all_of"),
        F.filter("ts", lambda x, i: i >= 2).alias("any_of"),
    )


@named(
    "term_cooccurrence",
    f"WITH {POSTINGS}, {_NEEDS}, hit AS (SELECT f.need_id, p.doc_id, count(*) FILTER (WHERE f.pos <= 2) AS m, "
    "count(*) FILTER (WHERE f.pos > 2) AS a FROM flat f JOIN posts p USING (term) GROUP BY ALL) "
    "SELECT n.need_id, count(h.doc_id) AS n_docs FROM needs n LEFT JOIN hit h ON h.need_id = n.need_id "
    "AND h.m = least(len(n.ts), 2) AND h.a > 0 GROUP BY n.need_id",
)
def term_cooccurrence(t):
    return lexical.cooccurrence(t.index, passage_needs(t))


@named(
    "bridge_terms",
    f"WITH {POSTINGS}, {STATS}, {IDF}, {QTERMS}, known AS (SELECT q.qid, q.term, i.idf FROM qterms q JOIN idf i USING (term)), "
    "shared AS (SELECT a.qid, a.term, count(DISTINCT p2.doc_id) AS n FROM known a JOIN posts p1 ON p1.term = a.term "
    "JOIN known b ON b.qid = a.qid AND b.term <> a.term JOIN posts p2 ON p2.term = b.term AND p2.doc_id = p1.doc_id "
    "WHERE a.idf >= 1.5 GROUP BY ALL), others AS (SELECT qid, count(*) AS c FROM known GROUP BY qid) "
    "SELECT k.qid, k.term, round(k.idf, 6) AS idf FROM known k JOIN others o USING (qid) LEFT JOIN shared s ON s.qid = k.qid AND s.term = k.term "
    "WHERE k.idf >= 1.5 AND o.c > 1 AND s.n IS NULL",
)
def bridge_terms(t):
    """Rare query terms that never share a document with any other known term of their query."""
    asked = lexical.query_terms(passages(t))
    post = t.index.postings(asked)
    known = asked.join(t.index.with_idf(asked), "term")
    # number of the query's known terms per (query, document): one means the term stands alone there
    matched = post.select("doc_id", "term").join(asked, "term")
    per_doc = matched.groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("term").alias("ts"))
    linked = per_doc.where("n > 1").select("qid", F.explode("ts").alias("term")).distinct()
    several = known.groupBy("qid").agg(F.count(F.lit(1)).alias("n_known")).where("n_known > 1").select("qid")
    return (
        known.where("idf >= 1.5")
        .join(several, "qid", "left_semi")
        .join(linked, ["qid", "term"], "left_anti")
        .select("qid", "term", F.round("idf", 6).alias("idf"))
    )


@named(
    "single_list_rank",
    f"WITH {BM25}, {ranked(50)} SELECT qid, doc_id, rank, round(1.0 / (60 + rank), 12) AS rrf FROM ranked",
)
def single_list_rank(t):
    from quarrymark.operators.rank import reciprocal

    top = lexical.bm25_top(t.index, passages(t), k=50)
    return top.select("qid", "doc_id", "rank", F.round(reciprocal(F.col("rank")), 12).alias("rrf"))


@named(
    "global_topk",
    f"WITH {BM25} SELECT qid, doc_id, score FROM scores ORDER BY score DESC, qid, doc_id LIMIT 100",
)
def global_topk(t):
    """The 100 best pairs of the whole batch: one take-ordered, no window."""
    return lexical.bm25_scores(t.index, passages(t)).orderBy(F.col("score").desc(), "qid", "doc_id").limit(100)
