"""Adaptive retrieval over the benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.functions import text as tx
from quarrymark.functions import values as vx
from quarrymark.operators import adaptive as ad
from quarrymark.operators import filters, lexical
from quarrymark.plans.claim_queries import VERIFY, aligned, own
from quarrymark.plans.corpus_queries import texts, texts_of
from quarrymark.plans.filter_queries import _CLAIMS, dated, order_claims
from quarrymark.plans.lexical_queries import bridge_terms, passages
from quarrymark.plans.registry import named
from quarrymark.plans.sql_parts import BM25, IDF, POSTINGS, QTERMS, STATS, ranked, sql_terms
from quarrymark.session import written

COMPARISON = r"(?i)\b(?:compared?|comparison|differences?|differs?|versus|vs)\b"


def vocabulary(t):
    return t.index.with_idf().select("term", "idf")


def known_terms(t):
    asked = lexical.query_terms(passages(t))
    return t.index.with_idf(asked).select("term", "idf")


def analysis(t):
    cue = vx.temporal_cue(F.col("query"))
    temporal = passages(t).select(
        "qid", cue["kind"].alias("kind"), cue["kind"].isin("date", "month", "year").alias("explicit"),
        F.col("query").rlike(COMPARISON).alias("comparison"), F.col("query").rlike(r"\b[A-Z]{2,}\d+\b").alias("exact_id"),
    )
    return ad.analyse_needs(lexical.query_terms(passages(t)), known_terms(t), bridge_terms(t), temporal)


_TEMPORAL = (
    "CASE WHEN try_cast(nullif(regexp_extract(text, '\\b(\\d{4}-\\d{2}-\\d{2})\\b', 1), '') AS DATE) IS NOT NULL THEN 'date' WHEN regexp_matches(lower(text), '\\b(" + "|".join(vx.MONTHS) + ") (\\d{4})\\b') THEN 'month' "
    "WHEN regexp_matches(lower(text), '\\b((?:19|20)\\d{2})\\b') THEN 'year' WHEN regexp_matches(lower(text), '\\b(?:currently|now|today|at present|nowadays)\\b') THEN 'current' WHEN regexp_matches(lower(text), '\\b(?:previously|formerly|used to|in the past|before)\\b') THEN 'past' ELSE 'none' END"
)
ANALYSIS = (
    f"{POSTINGS}, {STATS}, {IDF}, {QTERMS}, known AS (SELECT q.qid, q.term, i.idf FROM qterms q JOIN idf i USING (term)), "
    "pd AS (SELECT k.qid, p.doc_id, count(*) AS n FROM known k JOIN posts p USING (term) GROUP BY ALL), linked AS (SELECT DISTINCT k.qid, k.term FROM known k JOIN posts p USING (term) JOIN pd ON pd.qid = k.qid AND pd.doc_id = p.doc_id AND pd.n > 1), "
    "nk AS (SELECT qid, count(*) AS c FROM known GROUP BY qid), br AS (SELECT k.qid, count(*) AS n FROM known k JOIN nk USING (qid) WHERE k.idf >= 1.5 AND nk.c > 1 AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.qid = k.qid AND l.term = k.term) GROUP BY k.qid), "
    "co AS (SELECT q.qid, count(*) AS n, count(*) FILTER (WHERE i.idf IS NULL) AS n_oov, count(*) FILTER (WHERE i.idf >= 1.5) AS n_rare, round(max(i.idf), 6) AS max_idf FROM qterms q LEFT JOIN idf i USING (term) WHERE NOT regexp_matches(q.term, '^\\d+$') GROUP BY q.qid), "
    f"an AS (SELECT b.item_id AS qid, {_TEMPORAL} AS kind, regexp_matches(b.text, '{COMPARISON}') AS comparison, regexp_matches(b.text, '\\b[A-Z]{{2,}}\\d+\\b') AS exact_id, coalesce(co.n, 0) AS n, co.n_oov, co.n_rare, co.max_idf, coalesce(br.n, 0) AS nb, round(CASE WHEN coalesce(co.n, 0) > 0 THEN co.n_oov / co.n ELSE 0 END, 3) AS oov_ratio FROM benchmark b LEFT JOIN co ON co.qid = b.item_id LEFT JOIN br ON br.qid = b.item_id), "
    "ana AS (SELECT *, CASE WHEN nb > 0 THEN 'MULTI_HOP' WHEN comparison THEN 'COMPLEX' WHEN kind <> 'none' OR oov_ratio >= 0.5 OR n <= 1 OR n > 8 THEN 'MODERATE' ELSE 'SIMPLE' END AS complexity FROM an)"
)


@named("oov_ratio", f"WITH {ANALYSIS} SELECT qid, n AS n_content, coalesce(n_oov, 0) AS n_oov, coalesce(n_rare, 0) AS n_rare, max_idf, oov_ratio, complexity FROM ana")
def oov_ratio(t):
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return analysis(t).select("qid", zero("n_content"), zero("n_oov"), zero("n_rare"), "max_idf", "oov_ratio", "complexity")


@named(
    "router_strategy",
    f"WITH {ANALYSIS} SELECT qid, complexity, CASE WHEN complexity = 'MULTI_HOP' THEN 'MULTI_HOP' WHEN exact_id AND kind NOT IN ('date', 'month', 'year') AND complexity IN ('SIMPLE', 'MODERATE') THEN 'LEXICAL' WHEN kind IN ('date', 'month', 'year') THEN 'FILTERED' WHEN oov_ratio >= 0.5 THEN 'SEMANTIC' WHEN complexity = 'COMPLEX' THEN 'ITERATIVE' WHEN complexity = 'SIMPLE' THEN 'LEXICAL' ELSE 'HYBRID' END AS strategy, CASE complexity WHEN 'SIMPLE' THEN 3 ELSE 5 END AS first_k FROM ana",
)
def router_strategy(t):
    picked = ad.strategy(
        F.col("complexity"), F.col("exact_id"), F.col("explicit"), F.col("oov_ratio"), F.lit(True), F.lit(1500.0)
    )
    return analysis(t).select("qid", "complexity", picked.alias("strategy"), ad.first_k(F.col("complexity")).alias("first_k"))


@named(
    "query_expansion",
    f"WITH {POSTINGS}, {STATS}, {IDF}, qterms AS (SELECT DISTINCT conv_id AS qid, unnest({sql_terms('text')}) AS term FROM conversations), lost AS (SELECT q.qid, q.term FROM qterms q WHERE length(q.term) >= 4 AND NOT EXISTS (SELECT 1 FROM idf i WHERE i.term = q.term)), "
    "c AS (SELECT l.qid, l.term, i.term AS variant, i.idf FROM lost l JOIN idf i ON left(i.term, 4) = left(l.term, 4) AND length(i.term) >= 4 WHERE CASE WHEN length(l.term) <= length(i.term) THEN starts_with(i.term, l.term) AND NOT regexp_matches(l.term, '^\\d+$') ELSE starts_with(l.term, i.term) AND NOT regexp_matches(i.term, '^\\d+$') END) "
    "SELECT qid, term, variant, n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY idf, term, variant) AS n FROM c) WHERE n <= 3",
)
def query_expansion(t):
    """Every conversation is a query: variants for the words the documents do not know."""
    said = t.conversations.select(F.col("conv_id").alias("qid"), F.explode(tx.analyse(F.col("text"))).alias("term")).distinct()
    return ad.expansions(said, vocabulary(t))


def needs(t):
    asked = passages(t).select("qid", F.posexplode(tx.terms(F.col("query"))).alias("pos", "term"))
    return ad.anchors(asked, known_terms(t))


def judged(t, k: int = 20, asked=None):
    hits = written(lexical.bm25_top(t.index, passages(t), k=k).select("qid", "doc_id", "rank"), "hits")
    docs = texts_of(t, hits, "source").select("doc_id", "source", tx.terms(F.col("text")).alias("e"))
    return ad.judge(hits.join(docs, "doc_id"), needs(t) if asked is None else asked)


JUDGE = (
    f"{BM25}, {ranked(20)}, qp AS (SELECT qid, term, min(pos) AS pos FROM (SELECT item_id AS qid, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT item_id, {sql_terms('text')} AS ts FROM benchmark)) GROUP BY ALL), "
    "qd AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS p FROM qp), "
    "nd AS (SELECT q.qid, list(q.term) AS terms, CASE WHEN count(*) > 1 THEN arg_max(CASE WHEN NOT regexp_matches(q.term, '^\\d+$') THEN q.term END, (CASE WHEN regexp_matches(q.term, '^\\d+$') THEN -1.0 ELSE coalesce(i.idf, 'infinity'::DOUBLE) END, -q.p)) END AS anchor FROM qd q LEFT JOIN idf i USING (term) GROUP BY q.qid), "
    "ju0 AS (SELECT r.qid, r.doc_id, r.rank, s.source, n.anchor, d.toks, round(len(list_intersect(n.terms, d.toks)) / len(n.terms), 6) AS coverage FROM ranked r JOIN nd n USING (qid) JOIN doc_terms d USING (doc_id) JOIN documents s USING (doc_id)), "
    "ju AS (SELECT qid, doc_id, rank, source, coverage, coverage >= 0.6 AND (anchor IS NULL OR list_contains(toks, anchor)) AS supports FROM ju0)"
)
STEPS = (
    f"{JUDGE}, gr AS (SELECT qid, i, k FROM nd, (VALUES (0, 5), (1, 10), (2, 20)) v(i, k)), st0 AS (SELECT g.qid, g.i, g.k, count(*) FILTER (WHERE j.rank <= g.k) AS nr, coalesce(bool_or(j.supports AND j.rank <= g.k), false) AS met, coalesce(max(j.coverage) FILTER (WHERE j.rank <= g.k), 0.0) AS quality FROM gr g LEFT JOIN ju j USING (qid) GROUP BY ALL), "
    "st1 AS (SELECT *, round(CAST(met AS INT) - coalesce(lag(CAST(met AS INT)) OVER w, 0) + 0.5 * (quality - coalesce(lag(quality) OVER w, 0)), 4) AS gain FROM st0 WINDOW w AS (PARTITION BY qid ORDER BY i)), "
    "steps AS (SELECT qid, i + 1 AS iteration, k, met, quality, gain, CASE WHEN met THEN 'sufficient_evidence' WHEN nr = 0 THEN 'no_results' WHEN i + 1 >= 3 THEN 'iteration_limit' WHEN nr >= 40 THEN 'query_limit' WHEN i > 0 AND gain < 0.05 THEN 'no_expected_gain' END AS stop FROM st1)"
)


@named("sufficiency", f"WITH {JUDGE} SELECT qid, doc_id, rank, coverage, supports FROM ju")
def sufficiency(t):
    return judged(t).select("qid", "doc_id", "rank", "coverage", "supports")


@named(
    "need_status",
    f"WITH {JUDGE}, m AS (SELECT qid // 3 AS uid, qid, bool_or(supports) AS met, max(coverage) AS q FROM ju GROUP BY ALL), a AS (SELECT item_id AS qid, item_id // 3 AS uid FROM benchmark) "
    "SELECT a.uid, count(*) AS n, count(*) FILTER (WHERE m.met) AS n_met, round(avg(coalesce(m.q, 0)), 4) AS quality, CASE WHEN count(*) FILTER (WHERE m.met) = count(*) THEN 'SUFFICIENT' WHEN count(*) FILTER (WHERE m.met) > 0 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS status FROM a LEFT JOIN m USING (qid) GROUP BY a.uid",
)
def need_status(t):
    per = judged(t).groupBy("qid").agg(F.bool_or("supports").alias("met"), F.max("coverage").alias("q"))
    rows = passages(t).select("qid", F.floor(F.col("qid") / 3).alias("uid")).join(per, "qid", "left")
    sums = rows.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("met").alias("n_met"),
        F.round(F.avg(F.coalesce("q", F.lit(0.0))), 4).alias("quality"),
    )
    return sums.withColumn("status", ad.need_status(F.col("n"), F.col("n_met"), F.lit(0)))


@named("adaptive_steps", f"WITH {STEPS} SELECT qid, iteration, k, met, quality, gain, coalesce(stop, 'continue') AS stop FROM steps")
def adaptive_steps(t):
    asked = written(needs(t), "needs")
    steps = ad.iterations(judged(t, asked=asked), asked)
    return steps.withColumn("stop", F.coalesce("stop", F.lit("continue")))


@named("stop_reason", f"WITH {STEPS} SELECT qid, min(iteration) AS iteration, arg_min(stop, iteration) AS stop, arg_min(quality, iteration) AS quality FROM steps WHERE stop IS NOT NULL GROUP BY qid")
def stop_reason(t):
    asked = written(needs(t), "needs")
    return ad.stopping_point(ad.iterations(judged(t, asked=asked), asked))


@named(
    "expected_gains",
    f"WITH {JUDGE}, m AS (SELECT qid, 1.0 - max(coverage) AS open FROM ju GROUP BY qid) SELECT qid, a AS action, round(open * p, 4) AS gain FROM m, (VALUES ('hop', 0.7), ('requirement_query', 0.6), ('expand_k', 0.4), ('other', 0.3)) v(a, p)",
)
def expected_gains(t):
    """Expected gain of every next action: its prior times what is still open."""
    rows = judged(t).groupBy("qid").agg((1.0 - F.max("coverage")).alias("open"))
    each = rows.select("qid", "open", F.explode(F.array(*[F.lit(a) for a in ("hop", "requirement_query", "expand_k", "other")])).alias("action"))
    return each.select("qid", "action", ad.expected_gain(F.col("action"), F.col("open")).alias("gain"))


@named(
    "final_evidence",
    f"WITH {JUDGE}, g AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY supports DESC, rank) AS ig FROM ju), f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY supports DESC, rank) AS final_rank FROM g WHERE ig <= 3) SELECT qid, doc_id, final_rank FROM f WHERE final_rank <= 8",
)
def final_evidence(t):
    return ad.final_evidence(judged(t), "source").select("qid", "doc_id", "final_rank")


@named(
    "conflict_resolution",
    f"WITH {_CLAIMS}, s AS (SELECT d.o_custkey, year(d.start) AS y, g.old IS NOT NULL AS old, round((CASE WHEN g.old IS NULL THEN CASE d.status WHEN 'draft' THEN 0.4 WHEN 'archived' THEN 0.2 ELSE 1.0 END ELSE least(0.2, CASE d.status WHEN 'draft' THEN 0.4 WHEN 'archived' THEN 0.2 ELSE 1.0 END) END) "
    "* CASE d.doc_type WHEN 'policy' THEN 1.0 WHEN 'annex' THEN 0.9 WHEN 'catalogue' THEN 0.8 WHEN 'notice' THEN 0.7 ELSE 0.6 END, 4) AS a FROM dated d LEFT JOIN agreed g ON g.old = d.document_id), p AS (SELECT o_custkey, y, count(*) AS n, count(*) FILTER (WHERE old) AS n_old, max(a) AS top FROM s GROUP BY ALL), "
    "q AS (SELECT s.o_custkey, s.y, max(s.a) AS second FROM s JOIN p USING (o_custkey, y) WHERE s.a < p.top GROUP BY ALL) "
    "SELECT o_custkey, y, n, CASE WHEN n_old > 0 AND n_old < n THEN 'version_supersession' WHEN round(top - second, 6) >= 0.3 THEN 'authority' ELSE 'unresolved' END AS rule FROM p LEFT JOIN q USING (o_custkey, y) WHERE n > 1",
)
def conflict_resolution(t):
    """The orders of one customer and year disagree: which rule settles it."""
    gone = filters.agreed_supersession(order_claims(t)).select(F.col("old").cast("long").alias("document_id"), F.lit(True).alias("gone"))
    rows = dated(t).join(gone, "document_id", "left").withColumn("superseded", F.coalesce("gone", F.lit(False)))
    score = filters.authority(F.col("status"), F.col("doc_type"), F.col("superseded"))
    sides = rows.select("o_custkey", F.year("start").alias("y"), score.alias("authority"), "superseded")
    return ad.resolve_conflicts(sides, ["o_custkey", "y"])


@named(
    "cache_invalidation",
    f"WITH {BM25}, {ranked(10)} SELECT r.qid, count(*) AS n_evidence, count(*) FILTER (WHERE l.toxic = 1) AS n_withdrawn, bool_or(coalesce(l.toxic, 0) = 1) AS invalidated FROM ranked r LEFT JOIN labels l USING (doc_id) GROUP BY r.qid",
)
def cache_invalidation(t):
    """Cached answers whose evidence was withdrawn (documents labelled toxic) must be searched again."""
    entries = lexical.bm25_top(t.index, passages(t), k=10).select("qid", "doc_id")
    withdrawn = t.labels.where("toxic = 1").select("doc_id", F.lit(True).alias("gone"))
    return entries.join(withdrawn, "doc_id", "left").groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_evidence"),
        F.count_if("gone").alias("n_withdrawn"),
        F.coalesce(F.bool_or("gone"), F.lit(False)).alias("invalidated"),
    )


@named(
    "claim_cache",
    f"WITH {VERIFY}, sc AS (SELECT c.qid // 3 + 1 AS uid, list_distinct(flatten(list(c.terms))) AS e, count(*) AS n FROM vs v JOIN claims c USING (qid, claim) WHERE v.status = 'SUPPORTED' GROUP BY ALL), nq AS (SELECT item_id AS qid, item_id // 3 AS uid, list_distinct({sql_terms('text')}) AS terms FROM benchmark) "
    "SELECT nq.qid, sc.n AS n_claims, round(len(list_intersect(nq.terms, sc.e)) / len(nq.terms), 6) AS covered FROM nq JOIN sc USING (uid) WHERE len(nq.terms) > 0",
)
def claim_cache(t):
    """How much of a need the verified claims of the request before it already cover (at most twelve claims per request)."""
    from quarrymark.operators import claims as cl

    chosen, links = aligned(t)
    supported = cl.verify(links, own(chosen)).where("status = 'SUPPORTED'").join(chosen.select("qid", "claim", "terms"), ["qid", "claim"])
    pool = supported.groupBy((F.floor(F.col("qid") / 3) + 1).alias("uid")).agg(
        F.array_distinct(F.flatten(F.collect_list("terms"))).alias("e"), F.count(F.lit(1)).alias("n_claims")
    )
    asked = passages(t).select("qid", F.floor(F.col("qid") / 3).alias("uid"), tx.terms(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    share = F.round(F.size(F.array_intersect("terms", "e")) / F.size("terms"), 6)
    return asked.join(pool, "uid").select("qid", "n_claims", share.alias("covered"))


@named(
    "hop_targets",
    "SELECT lower(p[1]) AS entity, lower(p[2]) AS target, count(*) AS n FROM (SELECT unnest(list_zip(regexp_extract_all(text, '(\\p{L}{4,}) (?:is a|is an|is the|belongs to|refers to) (\\p{L}{4,})', 1), regexp_extract_all(text, '(\\p{L}{4,}) (?:is a|is an|is the|belongs to|refers to) (\\p{L}{4,})', 2))) AS p FROM documents) GROUP BY ALL",
)
def hop_targets(t):
    """`<entity> <relation> <target>` statements: the second query of a bridge."""
    rx = F.lit(r"(\p{L}{4,}) (?:is a|is an|is the|belongs to|refers to) (\p{L}{4,})")
    pairs = F.zip_with(
        F.regexp_extract_all("text", rx, 1), F.regexp_extract_all("text", rx, 2),
        lambda a, b: F.struct(F.lower(a).alias("entity"), F.lower(b).alias("target")),
    )
    return texts(t).select(F.explode(pairs).alias("p")).groupBy("p.entity", "p.target").agg(F.count(F.lit(1)).alias("n"))
