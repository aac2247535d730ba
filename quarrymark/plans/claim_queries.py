"""Claims of every passage from its five best documents, verified against the same documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.functions import text as tx
from quarrymark.functions import values as vx
from quarrymark.operators import claims as cl
from quarrymark.operators import lexical, state
from quarrymark.operators.joins import attach
from quarrymark.plans.corpus_queries import texts, texts_of
from quarrymark.plans.lexical_queries import passages
from quarrymark.plans.registry import named
from quarrymark.plans.sql_parts import BM25, ranked, sql_terms
from quarrymark.plans.text_queries import _SPLIT, _rx
from quarrymark.session import written


def weights(t):
    asked = lexical.query_terms(passages(t))
    known = asked.join(t.index.with_idf(asked), "term")
    return cl.query_weights(known.select("qid", "term", "idf"))


def evidence(t):
    """(qid, doc_id, rank) of the five best documents."""
    return lexical.bm25_top(t.index, passages(t), k=5).select("qid", "doc_id", "rank")


def evidence_sentences(t):
    """Sentences of the evidence; every document is cut once, whoever asked for it."""
    hits = written(evidence(t), "evidence")
    return hits.join(cl.sentence_rows(texts_of(t, hits), "doc_id"), "doc_id")


def selected(t):
    return cl.select(evidence_sentences(t), weights(t))


_POL = "\\b(?:" + "|".join(tx.POLARITY_WORDS) + ")\\b|n''t\\b"
SEN = (
    f"{BM25}, {ranked(5)}, sen0 AS (SELECT r.qid, r.doc_id, r.rank, {_SPLIT.replace('text', 'd.text')} AS ss FROM ranked r JOIN documents d USING (doc_id)), "
    "sen1 AS (SELECT qid, doc_id, rank, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM sen0), "
    f"sen AS (SELECT *, list_distinct({sql_terms('sentence')}) AS terms, list_sort(list_distinct(regexp_extract_all(sentence, '\\d+(?:[.,]\\d+)*'))) AS numbers, regexp_matches(lower(sentence), '{_POL}') AS negated FROM sen1 WHERE NOT regexp_matches(sentence, '{_rx(tx.INSTRUCTION)}'))"
)
CLAIMS = (
    f"{SEN}, qw AS (SELECT q.qid, q.term, i.idf FROM qterms q JOIN idf i USING (term) WHERE i.idf > 0), qt AS (SELECT qid, sum(idf) AS total, max(idf) AS top, count(*) AS n FROM qw GROUP BY qid), "
    "sx AS (SELECT qid, doc_id, pos, unnest(terms) AS term FROM sen), sh AS (SELECT sx.qid, sx.doc_id, sx.pos, sum(w.idf) AS s, count(*) AS n, max(w.idf) AS m FROM sx JOIN qw w ON w.qid = sx.qid AND w.term = sx.term GROUP BY ALL), "
    "cand AS (SELECT s.qid, s.doc_id, e.rank, s.pos, round(s.s / t.total, 4) AS relevance FROM sh s JOIN qt t USING (qid) JOIN sen e USING (qid, doc_id, pos) WHERE round(s.s / t.total, 4) >= 0.2 AND (s.n >= least(2, t.n) OR s.m = t.top)), "
    "claims AS (SELECT * FROM (SELECT c.*, e.sentence, e.terms, e.numbers, e.negated, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, c.rank, doc_id, pos) AS claim FROM cand c JOIN sen e USING (qid, doc_id, pos)) WHERE claim <= 4)"
)
ALIGN = (
    f"{CLAIMS}, prem AS (SELECT qid, doc_id, pos, 'sentence' AS kind, terms, numbers, negated FROM sen UNION ALL SELECT a.qid, a.doc_id, a.pos, 'window', list_distinct(list_concat(a.terms, b.terms)), list_distinct(list_concat(a.numbers, b.numbers)), a.negated OR b.negated FROM sen a JOIN sen b ON b.qid = a.qid AND b.doc_id = a.doc_id AND b.pos = a.pos + 1), "
    "j0 AS (SELECT c.qid, c.claim, p.doc_id, p.pos, p.kind, len(c.terms) AS n, len(list_intersect(c.terms, p.terms)) AS shared, list_has_all(p.numbers, c.numbers) AS nums, c.negated = p.negated AS same, len(c.numbers) AS cn, len(p.numbers) AS pn FROM claims c JOIN prem p USING (qid)), "
    "j AS (SELECT qid, claim, doc_id, pos, CASE WHEN n > 0 AND shared = n AND nums AND same THEN CASE WHEN kind = 'sentence' THEN 3 ELSE 2 END WHEN n > 0 AND shared / n >= 0.8 AND kind = 'sentence' AND ((cn > 0 AND pn > 0 AND NOT nums) OR NOT same) THEN 1 ELSE 0 END AS level, CASE WHEN n > 0 THEN shared / n ELSE 0.0 END AS overlap FROM j0), "
    "al AS (SELECT qid, claim, doc_id, CASE max(level) WHEN 3 THEN 'STRONG' WHEN 2 THEN 'MODERATE' WHEN 1 THEN 'CONTRADICTORY' ELSE CASE WHEN max(overlap) >= 0.5 THEN 'WEAK' ELSE 'NONE' END END AS strength, arg_min(pos, (-level, pos)) AS premise, round(max(overlap), 6) AS overlap FROM j GROUP BY ALL)"
)
VERIFY = (
    f"{ALIGN}, ve AS (SELECT a.qid, a.claim, count(*) FILTER (WHERE strength IN ('STRONG', 'MODERATE')) AS n_support, count(*) FILTER (WHERE strength = 'CONTRADICTORY') AS n_contra, count(*) FILTER (WHERE strength = 'WEAK') AS n_weak, "
    "count(*) FILTER (WHERE strength IN ('STRONG', 'MODERATE') AND a.doc_id <> c.doc_id) AS n_outside FROM al a JOIN claims c USING (qid, claim) GROUP BY a.qid, a.claim), "
    "vs AS (SELECT *, CASE WHEN n_contra > 0 THEN 'CONTRADICTED' WHEN n_support > 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS status FROM ve)"
)


@named("claim_select", f"WITH {CLAIMS} SELECT qid, claim, doc_id, pos, relevance, sha1(sentence) AS digest FROM claims")
def claim_select(t):
    return selected(t).select("qid", "claim", "doc_id", "pos", "relevance", F.sha1("sentence").alias("digest"))


def aligned(t):
    """Claims and how the evidence bears on them; sentences and claims are worked out once."""
    sentences = written(evidence_sentences(t), "evidence-sentences")
    chosen = written(cl.select(sentences, weights(t)), "claims")
    return chosen, cl.align(chosen, cl.premises(sentences))


def own(chosen):
    """A claim cites the document it was taken from."""
    return chosen.select("qid", "claim", "doc_id")


@named("align_rules", f"WITH {ALIGN} SELECT qid, claim, doc_id, strength, premise, overlap FROM al")
def align_rules(t):
    return aligned(t)[1]


@named("verify_claims", f"WITH {VERIFY} SELECT qid, claim, status, n_support, n_contra, n_weak, n_outside FROM vs")
def verify_claims(t):
    chosen, links = aligned(t)
    return cl.verify(links, own(chosen))


_STRETCH = "regexp_matches(sentence, '\\d')"


@named(
    "policy_actions",
    f"WITH {VERIFY} SELECT v.qid, v.claim, CASE WHEN status = 'SUPPORTED' THEN 'keep' WHEN status = 'CONTRADICTED' AND n_support > 0 THEN 'present_conflict' WHEN c.claim > 2 THEN 'restore_facts' WHEN status = 'UNSUPPORTED' AND regexp_matches(c.sentence, '\\d') THEN 'retrieve' ELSE 'remove' END AS action FROM vs v JOIN claims c USING (qid, claim)",
)
def policy_actions(t):
    """The first two claims have no planned facts behind them; one retrieval is left."""
    chosen, links = aligned(t)
    rows = cl.verify(links, own(chosen)).join(chosen.select("qid", "claim", "sentence"), ["qid", "claim"])
    act = cl.action(F.col("status"), F.col("n_support"), F.col("claim") > 2, F.lit(1), F.col("sentence").rlike(r"\d"))
    return rows.select("qid", "claim", act.alias("action"))


_CITE = (
    f"{ALIGN}, ci AS (SELECT * FROM (SELECT a.qid, a.claim, a.doc_id, a.strength, a.premise, row_number() OVER (PARTITION BY a.qid, a.claim ORDER BY CASE WHEN a.strength = 'STRONG' THEN 0 ELSE 1 END, CASE WHEN a.doc_id = c.doc_id THEN 0 ELSE 1 END, a.doc_id) AS citation "
    "FROM al a JOIN claims c USING (qid, claim) WHERE a.strength IN ('STRONG', 'MODERATE')) WHERE citation <= 2)"
)


@named("citation_map", f"WITH {_CITE} SELECT qid, claim, citation, doc_id, strength, premise FROM ci")
def citation_map(t):
    chosen, links = aligned(t)
    return cl.cite(links, own(chosen))


@named(
    "citation_report",
    f"WITH {_CITE}, ev AS (SELECT qid, count(*) AS n_evidence FROM ranked GROUP BY qid), c1 AS (SELECT qid, count(*) AS n_claims FROM claims GROUP BY qid), c2 AS (SELECT qid, count(*) AS n_citations, count(DISTINCT claim) AS n_cited, count(DISTINCT doc_id) AS n_used FROM ci GROUP BY qid) "
    "SELECT ev.qid, coalesce(n_claims, 0) AS n_claims, coalesce(n_citations, 0) AS n_citations, coalesce(n_claims, 0) - coalesce(n_cited, 0) AS orphan_claims, n_evidence - coalesce(n_used, 0) AS unused_evidence, round(n_cited / n_claims, 6) AS citation_coverage FROM ev LEFT JOIN c1 USING (qid) LEFT JOIN c2 USING (qid)",
)
def citation_report(t):
    chosen, links = aligned(t)
    cites = cl.cite(links, own(chosen))
    per_claims = chosen.groupBy("qid").agg(F.count(F.lit(1)).alias("n_claims"))
    per_cites = cites.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_citations"), F.countDistinct("claim").alias("n_cited"), F.countDistinct("doc_id").alias("n_used")
    )
    per_ev = evidence(t).groupBy("qid").agg(F.count(F.lit(1)).alias("n_evidence"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per_ev.join(per_claims, "qid", "left").join(per_cites, "qid", "left").select(
        "qid",
        zero("n_claims").alias("n_claims"),
        zero("n_citations").alias("n_citations"),
        (zero("n_claims") - zero("n_cited")).alias("orphan_claims"),
        (F.col("n_evidence") - zero("n_used")).alias("unused_evidence"),
        F.round(F.col("n_cited") / F.col("n_claims"), 6).alias("citation_coverage"),
    )


@named(
    "coverage_report",
    f"WITH {VERIFY}, k AS (SELECT qid // 3 AS uid, qid, count(*) FILTER (WHERE status = 'SUPPORTED') AS facts, count(*) AS n FROM vs GROUP BY ALL), a AS (SELECT item_id // 3 AS uid, item_id AS qid FROM benchmark) "
    "SELECT a.uid, count(*) AS n_needs, count(*) FILTER (WHERE k.facts > 0) AS covered, count(*) FILTER (WHERE k.facts = 0) AS uncertain_only, count(*) FILTER (WHERE k.qid IS NULL) AS failures, round(count(*) FILTER (WHERE k.facts > 0) / count(*), 4) AS fact_coverage FROM a LEFT JOIN k USING (qid) GROUP BY a.uid",
)
def coverage_report(t):
    chosen, links = aligned(t)
    facts = cl.verify(links, own(chosen)).groupBy("qid").agg(F.count_if(F.col("status") == "SUPPORTED").alias("facts"))
    needs = passages(t).select("qid", F.floor(F.col("qid") / 3).alias("uid")).join(facts, "qid", "left")
    covered = F.count_if(F.col("facts") > 0)
    return needs.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_needs"),
        covered.alias("covered"),
        F.count_if(F.col("facts") == 0).alias("uncertain_only"),
        F.count_if(F.col("facts").isNull()).alias("failures"),
        F.round(covered / F.count(F.lit(1)), 4).alias("fact_coverage"),
    )


@named(
    "grounding_metrics",
    f"WITH {VERIFY} SELECT qid % 5 AS category, count(*) AS n_claims, round(avg(CASE WHEN status = 'SUPPORTED' THEN 1 ELSE 0 END), 6) AS support_rate, round(avg(CASE WHEN status = 'UNSUPPORTED' THEN 1 ELSE 0 END), 6) AS unsupported_rate, round(avg(CASE WHEN status = 'CONTRADICTED' THEN 1 ELSE 0 END), 6) AS contradicted_rate, round(sum(n_outside) / nullif(sum(n_support), 0), 6) AS outside_share FROM vs GROUP BY ALL",
)
def grounding_metrics(t):
    chosen, links = aligned(t)
    rows = cl.verify(links, own(chosen))
    share = lambda s: F.round(F.avg((F.col("status") == s).cast("int")), 6)
    return rows.groupBy((F.col("qid") % 5).alias("category")).agg(
        F.count(F.lit(1)).alias("n_claims"),
        share("SUPPORTED").alias("support_rate"),
        share("UNSUPPORTED").alias("unsupported_rate"),
        share("CONTRADICTED").alias("contradicted_rate"),
        F.round(F.sum("n_outside") / F.nullif(F.sum("n_support"), F.lit(0)), 6).alias("outside_share"),
    )


@named(
    "render_answers",
    f"WITH {VERIFY}, ln AS (SELECT v.qid, v.claim, CASE WHEN status = 'SUPPORTED' THEN c.sentence || ' [D' || c.doc_id || ']' WHEN status = 'CONTRADICTED' THEN 'The sources differ: ' || c.sentence || ' [D' || c.doc_id || ']' ELSE 'Not established.' END AS line FROM vs v JOIN claims c USING (qid, claim)) "
    "SELECT qid, count(*) AS n_claims, sha1(string_agg(line, ' ' ORDER BY claim)) AS digest FROM ln GROUP BY qid",
)
def render_answers(t):
    chosen, links = aligned(t)
    rows = cl.verify(links, own(chosen)).join(chosen.select("qid", "claim", "doc_id", "sentence"), ["qid", "claim"])
    cited = F.concat(F.col("sentence"), F.lit(" [D"), F.col("doc_id").cast("string"), F.lit("]"))
    line = (
        F.when(F.col("status") == "SUPPORTED", cited)
        .when(F.col("status") == "CONTRADICTED", F.concat(F.lit("The sources differ: "), cited))
        .otherwise("Not established.")
    )
    facts = rows.select("qid", "claim", line.alias("line"))
    n = facts.groupBy("qid").agg(F.count(F.lit(1)).alias("n_claims"))
    return cl.render(facts).join(n, "qid").select("qid", "n_claims", F.sha1("answer").alias("digest"))


@named(
    "claim_consistency",
    f"WITH {CLAIMS} SELECT a.qid, a.claim AS claim_a, b.claim AS claim_b FROM claims a JOIN claims b ON a.qid = b.qid AND a.claim < b.claim WHERE len(a.terms) > 0 AND list_sort(a.terms) = list_sort(b.terms) AND (a.numbers <> b.numbers OR a.negated <> b.negated)",
)
def claim_consistency(t):
    return cl.consistency(selected(t))


@named(
    "claim_atoms",
    f"WITH {CLAIMS}, p AS (SELECT qid, claim, sentence, regexp_split_to_array(sentence, '\\s*;\\s*|\\s+(?:and|but|while)\\s+') AS ps FROM claims) "
    "SELECT qid, claim, CASE WHEN len(ps) > 1 AND len(list_filter(ps, lambda x: len(regexp_split_to_array(trim(x), '\\s+')) < 2)) = 0 THEN len(ps) ELSE 1 END AS n_atoms FROM p",
)
def claim_atoms(t):
    return selected(t).select("qid", "claim", F.size(cl.atoms(F.col("sentence"))).alias("n_atoms"))


@named(
    "claim_diff_by_key",
    f"WITH {CLAIMS}, f AS (SELECT qid, claim, sentence, coalesce(list_sort(terms)[1], '') AS fact FROM claims), o AS (SELECT qid, claim, sentence, fact FROM f WHERE claim % 2 = 1 OR claim = 4), n AS (SELECT qid, claim, CASE WHEN claim = 1 THEN sentence || '!' ELSE sentence END AS sentence, fact FROM f WHERE claim <= 3), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY qid, fact ORDER BY claim) AS k FROM o WHERE (qid, sentence) NOT IN (SELECT (qid, sentence) FROM n)), h AS (SELECT *, row_number() OVER (PARTITION BY qid, fact ORDER BY claim) AS k FROM n WHERE (qid, sentence) NOT IN (SELECT (qid, sentence) FROM o)), "
    "d AS (SELECT coalesce(g.qid, h.qid) AS qid, CASE WHEN g.qid IS NOT NULL AND h.qid IS NOT NULL THEN 'modified' WHEN g.qid IS NOT NULL THEN 'retracted' ELSE 'added' END AS change FROM g FULL OUTER JOIN h ON g.qid = h.qid AND g.fact = h.fact AND g.k = h.k UNION ALL SELECT qid, 'kept' FROM n WHERE (qid, sentence) IN (SELECT (qid, sentence) FROM o)) "
    "SELECT qid, change, count(*) AS n FROM d GROUP BY ALL",
)
def claim_diff_by_key(t):
    """Two versions of every answer: the later one drops the fourth claim, adds the second and rewords the first."""
    fact = F.coalesce(F.try_element_at(F.array_sort("terms"), F.lit(1)), F.lit(""))
    base = selected(t).select("qid", "claim", "sentence", fact.alias("fact"))
    old = base.where("claim % 2 = 1 OR claim = 4")
    new = base.where("claim <= 3").withColumn(
        "sentence", F.when(F.col("claim") == 1, F.concat("sentence", F.lit("!"))).otherwise(F.col("sentence"))
    )
    return cl.diff_by_fact(old, new).groupBy("qid", "change").agg(F.count(F.lit(1)).alias("n"))


# --- conflicts between sources ----------------------------------------------------------------------------------

_FACT = "(\\d+(?:[.,]\\d+)?)[ ]?(\\p{L}+|%)"


def number_facts(t):
    """(doc_id, unit, value, word): every number with the word after it, and the words of its line as context."""
    lines = texts(t).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"\d"))
    facts = F.arrays_zip(
        F.regexp_extract_all("line", F.lit(_FACT), 1).alias("v"), F.regexp_extract_all("line", F.lit(_FACT), 2).alias("u")
    )
    words = F.array_distinct(F.filter(tx.analyse(F.col("line")), lambda w: ~w.rlike(r"\d")))
    rows = lines.select("doc_id", words.alias("ws"), F.explode(facts).alias("f"))
    return rows.select(
        "doc_id", vx.unit_sign(F.col("f.u")).alias("unit"), vx.plain(F.col("f.v")).alias("value"), F.explode("ws").alias("word")
    ).where(F.col("word") != F.col("unit"))


_SINGLE = "regexp_replace(CASE WHEN length(u) > 2 AND lower(u) LIKE '%s' THEN left(lower(u), -1) ELSE lower(u) END, '(met|lit)re$', '\\1er')"
_UNIT_SQL = f"CASE {_SINGLE} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in vx.UNIT_SIGNS.items()) + f" ELSE {_SINGLE} END"
FACTS = (
    "ll AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), "
    f"fz AS (SELECT doc_id, list_distinct(list_filter({sql_terms('line')}, lambda w: NOT regexp_matches(w, '\\d'))) AS ws, unnest(list_zip(regexp_extract_all(line, '{_FACT}', 1), regexp_extract_all(line, '{_FACT}', 2))) AS z FROM ll WHERE regexp_matches(line, '\\d')), "
    f"fy AS (SELECT doc_id, ws, z[1] AS v, z[2] AS u FROM fz), fx AS (SELECT doc_id, {_UNIT_SQL} AS unit, regexp_replace(replace(v, ',', '.'), '\\.0$', '') AS value, unnest(ws) AS word FROM fy), facts AS (SELECT * FROM fx WHERE word <> unit)"
)


@named(
    "numeric_conflicts",
    f"WITH {FACTS}, m AS (SELECT DISTINCT unit, word, doc_id, value FROM facts) SELECT unit, word, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS n_docs, min(value) AS low, max(value) AS high FROM m GROUP BY unit, word "
    "HAVING count(DISTINCT value) > 1 AND count(DISTINCT doc_id) > 1",
)
def numeric_conflicts(t):
    """Units and context words for which different documents state different values: found by counting, never by pairing."""
    facts = number_facts(t).distinct()
    per_value = facts.groupBy("unit", "word", "value").agg(F.count(F.lit(1)).alias("c"))
    values = per_value.groupBy("unit", "word").agg(
        F.count(F.lit(1)).alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    docs = facts.select("unit", "word", "doc_id").distinct().groupBy("unit", "word").agg(F.count(F.lit(1)).alias("n_docs"))
    return values.join(docs, ["unit", "word"]).where("n_values > 1 AND n_docs > 1")


@named(
    "conflict_groups",
    f"WITH RECURSIVE {FACTS}, m AS (SELECT unit, word, min(doc_id) AS hub FROM facts GROUP BY unit, word HAVING count(DISTINCT value) > 1 AND count(DISTINCT doc_id) > 1), e AS (SELECT DISTINCT f.doc_id AS x, m.hub AS y FROM facts f JOIN m USING (unit, word) WHERE f.doc_id <> m.hub), "
    "b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT DISTINCT x AS node, x AS reach FROM b UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.reach) SELECT node, min(reach) AS conflict_group FROM r GROUP BY node",
)
def conflict_groups(t):
    """Documents linked by conflicting values, grouped under the smallest member.  Every conflict is a star around its smallest
    document, so its edges grow with its documents, not with their pairs."""
    facts = number_facts(t).distinct()
    hubs = facts.groupBy("unit", "word").agg(
        F.min("doc_id").alias("hub"),
        F.countDistinct("value").alias("n_values"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.count(F.lit(1)).alias("n"),
    )
    stars = attach(facts, hubs.where("n_values > 1 AND n_docs > 1"), ["unit", "word"])
    edges = stars.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    return state.components(edges).withColumnRenamed("group", "conflict_group")
