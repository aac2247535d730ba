"""Needs of a conversation: slots, queries, constraints over turns, late details; and cleaning of page edges and markers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymark.functions import text as tx
from quarrymark.operators import lexical, needs
from quarrymark.operators import dialogue as dg
from quarrymark.plans.corpus_queries import texts
from quarrymark.plans.dialogue_queries import _L, _WORDS, DRAFTS, drafts, needs_only, scored_intents
from quarrymark.plans.lexical_queries import passages
from quarrymark.plans.registry import named
from quarrymark.plans.sql_parts import BM25, ranked, sql_terms

_EDGES = (
    "p AS (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents), "
    "n AS (SELECT source, doc_id, unnest(list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i]) <> '')) AS i, ls FROM p), "
    "o AS (SELECT source, doc_id, i, ls[i] AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS a, count(*) OVER (PARTITION BY doc_id) AS m FROM n), "
    "e AS (SELECT *, CASE WHEN a <= CASE WHEN m >= 6 THEN 2 ELSE 1 END THEN 'top' WHEN m - a < CASE WHEN m >= 6 THEN 2 ELSE 1 END THEN 'bottom' END AS side, regexp_replace(lower(line), '\\d+', '#', 'g') AS key FROM o), "
    "g AS (SELECT source, side, key, count(DISTINCT doc_id) AS c FROM e WHERE side IS NOT NULL GROUP BY ALL), "
    "s AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), "
    "k AS (SELECT g.source, g.side, g.key FROM g JOIN s USING (source) WHERE s.pages >= 3 AND g.c >= 0.6 * s.pages)"
)


@named(
    "strip_edges",
    f"WITH {_EDGES}, d AS (SELECT e.doc_id, e.side, e.line, k.key IS NOT NULL AS repeated, regexp_matches(trim(e.line), '^([-–—] ?)?(?i:page )?\\d{{1,4}}( ?(of|/) ?\\d{{1,4}})?( ?[-–—])?$') AS numbered FROM e LEFT JOIN k ON k.source = e.source AND k.side = e.side AND k.key = e.key WHERE e.side IS NOT NULL) "
    "SELECT p.doc_id, count(*) FILTER (WHERE d.repeated) AS n_repeated, count(*) FILTER (WHERE d.numbered AND NOT d.repeated) AS n_page_numbers FROM p LEFT JOIN d USING (doc_id) GROUP BY p.doc_id",
)
def strip_edges(t):
    """Edge lines of every page that go: those that recur on its source's pages, and page numbers."""
    pages = t.documents.select("source", "doc_id", "text")
    return needs.edge_removals(pages, "source", "doc_id").select("doc_id", "n_repeated", "n_page_numbers")


# Documents as pages of a bulletin: a running header with a number, and a page number in one of two forms.
_PAGED = "concat(source, ' bulletin, issue ', doc_id, chr(10), text, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('Page ', doc_id % 900, ' of 900') ELSE concat('- ', doc_id % 900, ' -') END)"


@named(
    "stripped_pages",
    f"WITH dx AS (SELECT source, doc_id, {_PAGED} AS text FROM documents), {_EDGES.replace('FROM documents', 'FROM dx')}, "
    "gone AS (SELECT e.doc_id, e.i FROM e LEFT JOIN k ON k.source = e.source AND k.side = e.side AND k.key = e.key WHERE e.side IS NOT NULL "
    "AND (k.key IS NOT NULL OR regexp_matches(trim(e.line), '^([-–—] ?)?(?i:page )?\\d{1,4}( ?(of|/) ?\\d{1,4})?( ?[-–—])?$'))), "
    "al AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM p) "
    "SELECT al.doc_id, count(gone.i) AS n_removed, sha1(coalesce(string_agg(ls[al.i], chr(10) ORDER BY al.i) FILTER (WHERE gone.i IS NULL), '')) AS digest "
    "FROM al LEFT JOIN gone ON gone.doc_id = al.doc_id AND gone.i = al.i GROUP BY al.doc_id",
)
def stripped_pages(t):
    """The text of every page without its running header and page number."""
    pages = texts(t, "source").select("source", "doc_id", F.expr(_PAGED).alias("text"))
    rows = needs.without_edges(pages, "source", "doc_id")
    return rows.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.sha1("text").alias("digest"))


# Answers carry labels; here every sentence end of the documents gets some, and brackets that are none.
_LABELLED = "replace(text, '. ', concat(' [E', doc_id, '; F2]. (E3) [Ex] (see E4) '))"
_LABEL = "[\\[(] *[EF][0-9]+ *([,;/] *[EF][0-9]+ *)*[\\])]"


@named(
    "strip_markers",
    f"WITH l AS (SELECT doc_id, {_LABELLED} AS text FROM documents) SELECT doc_id, len(regexp_extract_all(text, '{_LABEL}')) AS n_markers, "
    f"sha1(trim(regexp_replace(regexp_replace(text, ' *{_LABEL}', '', 'g'), ' +([.,;:!?])', '\\1', 'g'))) AS digest FROM l",
)
def strip_markers(t):
    """The documents as labelled answers, without their labels."""
    labelled = texts(t).select("doc_id", F.expr(_LABELLED).alias("text"))
    return labelled.select(
        "doc_id", F.size(needs.markers(F.col("text"))).alias("n_markers"), F.sha1(needs.without_markers(F.col("text"))).alias("digest")
    )


_ASKED = " ".join(
    f"WHEN regexp_matches(array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' '), '{rx}') THEN '{kind}'" for kind, rx in needs.ASKED.items()
)


@named("asked_value_kind", f"SELECT conv_id, turn, coalesce(CASE {_ASKED} END, 'none') AS kind FROM conversations")
def asked_value_kind(t):
    return t.conversations.select("conv_id", "turn", F.coalesce(needs.asked_kind(F.col("text")), F.lit("none")).alias("kind"))


_CONDITIONS = f"{DRAFTS}, cond AS (SELECT session, utterance, ord, clause, terms FROM dr WHERE role = 'constraint')"


@named(
    "need_queries",
    f"WITH {_CONDITIONS}, j AS (SELECT k.session, k.utterance, k.ord, k.terms, list_sort(list_distinct(flatten(coalesce(list(c.terms) FILTER (WHERE c.terms IS NOT NULL), [])))) AS ct FROM sc k LEFT JOIN cond c USING (session, utterance) GROUP BY ALL) "
    "SELECT session, utterance, ord, len(terms) AS n_own, len(list_filter(ct, lambda x: NOT list_contains(terms, x))) AS n_added, sha1(array_to_string(list_sort(list_distinct(list_concat(terms, ct))), ' ')) AS digest FROM j",
)
def need_queries(t):
    """The query of every need: its own terms and those of the utterance's constraints that it lacks."""
    rows = drafts(t)
    conditions = rows.where("role = 'constraint'").select("session", "utterance", "terms")
    return needs.queries(needs_only(rows).select("session", "utterance", "ord", "terms"), conditions)


@named(
    "requirement_slots",
    f"WITH {_CONDITIONS}, q AS (SELECT session, utterance, ord, terms, coalesce(CASE {_ASKED.replace('lower(text)', 'lower(clause)')} END, '') AS asked FROM sc), "
    "s AS (SELECT session, utterance, ord, 0 AS part, CASE WHEN asked = '' THEN 'fact' ELSE 'value' END AS kind, asked, terms FROM q "
    "UNION ALL SELECT q.session, q.utterance, q.ord, c.ord + 1, 'condition', '', c.terms FROM q JOIN cond c USING (session, utterance) WHERE len(c.terms) > 0) "
    "SELECT session, utterance, ord, row_number() OVER (PARTITION BY session, utterance, ord ORDER BY part) AS slot, kind, asked, len(terms) AS n_terms FROM s",
)
def requirement_slots(t):
    """What an answer must show: the value or fact asked for, and every condition of the utterance."""
    rows = drafts(t)
    conditions = rows.where("role = 'constraint' AND size(terms) > 0").select("session", "utterance", F.col("ord").alias("at"), "terms")
    asked = needs_only(rows).select("session", "utterance", "ord", "clause", "terms")
    return needs.slots(asked, conditions).select("session", "utterance", "ord", "slot", "kind", "asked", F.size("terms").alias("n_terms"))


@named(
    "constraint_operations",
    f"WITH {_CONDITIONS}, h AS (SELECT *, ({sql_terms('clause')})[-1] AS head, list_sort(terms) AS sorted FROM cond WHERE len(terms) > 0), "
    "l AS (SELECT *, lag(sorted) OVER w AS before, lag(utterance) OVER w AS earlier FROM h WINDOW w AS (PARTITION BY session, head ORDER BY utterance, ord)) "
    "SELECT session, utterance, ord, head, CASE WHEN before IS NULL THEN 'set' WHEN before = sorted THEN 'repeat' ELSE 'update' END AS operation, earlier AS replaces FROM l",
)
def constraint_operations(t):
    """A constraint with the same head term as an earlier one of its conversation updates it; one with the same terms repeats it."""
    rows = drafts(t).where("role = 'constraint' AND size(terms) > 0")
    head = F.try_element_at(tx.analyse(F.col("clause")), F.lit(-1))
    return needs.operations(rows.select("session", "utterance", "ord", "terms", head.alias("head")))


_RESTRICTS = f"len(list_filter({_WORDS.format('c.text')}, lambda w: w IN {_L(dg.RESTRICTIONS)})) > 0"


@named(
    "late_detail_gate",
    f"WITH {DRAFTS}, a AS (SELECT session, min(utterance) AS first FROM sc GROUP BY session) "
    f"SELECT c.conv_id, c.turn, coalesce(a.first < c.turn, false) AS has_need, {_RESTRICTS} AS cue, coalesce(a.first < c.turn, false) AND {_RESTRICTS} AND NOT regexp_matches(c.text, '\\?') AS passes FROM conversations c LEFT JOIN a ON a.session = c.conv_id",
)
def late_detail_gate(t):
    """A turn that asks nothing itself but restricts an earlier need of its conversation is a late detail."""
    first = scored_intents(t).groupBy(F.col("session").alias("conv_id")).agg(F.min("utterance").alias("first"))
    rows = t.conversations.select("conv_id", "turn", "text").join(first, "conv_id", "left")
    has_need = F.coalesce(F.col("first") < F.col("turn"), F.lit(False))
    cue = needs.restricts(F.col("text"))
    return rows.select(
        "conv_id", "turn", has_need.alias("has_need"), cue.alias("cue"), (has_need & cue & ~F.col("text").contains("?")).alias("passes")
    )


@named(
    "applicability_exclusion",
    f"WITH {BM25}, {ranked(10)}, w AS (SELECT r.qid, arg_min(d.lang, r.rank) AS wanted FROM ranked r JOIN documents d USING (doc_id) GROUP BY r.qid) "
    "SELECT r.qid, r.doc_id, r.rank, CASE WHEN d.lang IS NULL OR d.lang IN (w.wanted, 'all') THEN 'kept' ELSE 'not_applicable:lang' END AS outcome FROM ranked r JOIN documents d USING (doc_id) JOIN w USING (qid)",
)
def applicability_exclusion(t):
    """Hits whose document names another language than the best hit's are left out with the reason."""
    hits = lexical.bm25_top(t.index, passages(t), k=10).select("qid", "doc_id", "rank")
    known = hits.join(t.documents.select("doc_id", "lang"), "doc_id")
    wanted = F.first("lang").over(Window.partitionBy("qid").orderBy("rank"))  # a list of ten
    return known.select("qid", "doc_id", "rank", needs.applicability(F.col("lang"), wanted, "lang").alias("outcome"))
