"""Dialogue rules over the conversations, with term statistics of the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymark.config import CONTROLLER
from quarrymark.functions import text as tx
from quarrymark.operators import corpus, lexical, state
from quarrymark.operators import dialogue as dg
from quarrymark.plans.registry import named
from quarrymark.plans.sql_parts import DOC_TERMS, sql_terms
from quarrymark.plans.state_queries import turn_bucket
from quarrymark.sources.tables import dealt

_L = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_WORDS = "regexp_extract_all(lower({0}), '[A-Za-z0-9]+(?:[''’\\-][A-Za-z0-9]+)*')"


def _phr(text: str, phrases) -> str:
    return f"regexp_matches(lower({text}), '\\b(?:{'|'.join(sorted(phrases, key=lambda p: (-len(p), p)))})\\b')"


NORM = "norm AS (SELECT ln(1 + (count(*) - 0.5) / 1.5) AS norm FROM documents)"
_IDF = "ix AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM doc_terms) GROUP BY term)"
SAID = (
    f"{DOC_TERMS}, {_IDF}, {NORM}, sd AS (SELECT DISTINCT conv_id, turn, unnest({sql_terms('text')}) AS term FROM conversations), "
    "st AS (SELECT conv_id, turn, count(*) AS n_terms, count(*) FILTER (WHERE i.idf >= 1.0) AS n_anchors, max(i.idf) FILTER (WHERE i.idf >= 1.0) AS max_idf FROM sd LEFT JOIN ix i USING (term) GROUP BY ALL)"
)


def _any(ws: str, table) -> str:
    return f"len(list_filter({ws}, lambda w: w IN {_L(table)})) > 0"


def act_sql(text: str, anchored: str) -> str:
    ws = _WORDS.format(text)
    rest = f"list_filter({ws}, lambda w: w NOT IN {_L(dg.REWORK + dg.REWORK_OBJECTS + dg.FILLERS + dg.CONTINUERS + dg.AUX_FIRST)})"
    first = f"list_filter({ws}, lambda w: w NOT IN {_L(dg.FILLERS + dg.GREETINGS + dg.CONTINUERS)})[1]"
    return (
        f"CASE WHEN len(list_filter({ws}, lambda w: w NOT IN {_L(dg.FILLERS + dg.CONTINUERS)})) = 0 THEN 'BACKCHANNEL' WHEN {_phr(text, dg.MORE_PHRASES)} THEN 'INFO_REQUEST' WHEN {_phr(text, dg.META_PHRASES)} AND NOT {anchored} THEN 'META' "
        f"WHEN {_any(ws, dg.REWORK)} AND len({rest}) = 0 THEN 'PRESENTATION' WHEN contains({text}, '?') OR {_any(ws, dg.QUESTION_WORDS)} OR {_phr(text, dg.REQUEST_HEADS)} THEN 'INFO_REQUEST' "
        f"WHEN coalesce({first} IN {_L(dg.AUX_FIRST)}, false) THEN 'INFO_REQUEST' WHEN {_any(ws, dg.GREETINGS)} AND NOT {anchored} THEN 'SOCIAL' ELSE 'UNKNOWN' END"
    )


def idf_of_documents(t):
    return t.index.with_idf().select("term", "idf")


def anchor_norm(t):
    """Idf of a term found in exactly one document."""
    return t.documents.agg(F.log1p((F.count(F.lit(1)) - 0.5) / 1.5)).scalar()


def term_signals(rows, t, keys: list[str], terms: str = "terms", grows: bool = False):
    """Add n_terms, n_anchors, max_idf (over anchors) per row of terms; with ``grows`` a row holds a piece of what it stands for."""
    if grows:
        return _growing_signals(rows, t, keys, terms)
    said = rows.select(*keys, F.explode(terms).alias("term"))
    per = said.join(idf_of_documents(t), "term", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.count_if(F.col("idf") >= CONTROLLER.anchor_idf_floor).alias("n_anchors"),
        F.max(F.when(F.col("idf") >= CONTROLLER.anchor_idf_floor, F.col("idf"))).alias("max_idf"),
    )
    zero = {"n_terms": 0, "n_anchors": 0}
    return rows.join(per, keys, "left").fillna(zero)


def _growing_signals(rows, t, keys: list[str], terms: str):
    """``term_signals`` of rows that hold a piece each, in the order of ``tick``, the last of the keys: of all terms up to the row's piece.

    A ``final`` row holds all its terms itself.  ``copy``, the key before, tells rows with the same other keys apart; they count
    together, as in ``term_signals``.  A term is looked up once for a copy, with the first piece that has it.
    """
    *outer, copy, tick = keys
    found = rows.select(*keys, "final", F.explode_outer(terms).alias("term"))
    said = found.where("term IS NOT NULL").groupBy(*outer, copy, "term").agg(F.min(F.when(~F.col("final"), F.col(tick))).alias(tick), F.max("final").alias("whole"))
    anchor = F.col("idf") >= CONTROLLER.anchor_idf_floor
    new = said.join(idf_of_documents(t), "term", "left").groupBy(*keys, "whole").agg(
        F.count(F.lit(1)).alias("new_terms"), F.count_if(anchor).alias("new_anchors"), F.max(F.when(anchor, F.col("idf"))).alias("new_idf")
    )
    both = rows.unionByName(new, allowMissingColumns=True).repartition(*outer)
    seen = Window.partitionBy(*outer, copy).orderBy(tick)

    def upto(total, c: str):
        started = total(F.when(F.col(tick).isNotNull(), F.col(c))).over(seen)
        return F.when(F.col("final"), total(F.when(F.col("whole"), F.col(c))).over(seen)).otherwise(started)

    counted = both.withColumns({"n_terms": upto(F.sum, "new_terms"), "n_anchors": upto(F.sum, "new_anchors"), "max_idf": upto(F.max, "new_idf")})
    every = Window.partitionBy(*outer, tick).orderBy(copy).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named_ = " AND ".join(f"{k} IS NOT NULL" for k in outer)  # a row without a key has no counts; not filtered, or the texts are dealt out twice
    per = {c: F.when(F.expr(named_), total(c).over(every)) for total, c in ((F.sum, "n_terms"), (F.sum, "n_anchors"), (F.max, "max_idf"))}
    return counted.where("final IS NOT NULL").select(*rows.columns, *[c.alias(n) for n, c in per.items()]).fillna({"n_terms": 0, "n_anchors": 0})


def turns(t):
    rows = t.conversations.select("conv_id", "turn", "text", tx.terms(F.col("text")).alias("terms"))
    return term_signals(rows, t, ["conv_id", "turn"])


@named(
    "dialogue_acts",
    f"WITH {SAID} SELECT c.conv_id, c.turn, {act_sql('c.text', '(coalesce(s.n_anchors, 0) > 0)')} AS act, coalesce(s.n_anchors, 0) AS n_anchors FROM conversations c LEFT JOIN st s USING (conv_id, turn)",
)
def dialogue_acts(t):
    return turns(t).select("conv_id", "turn", dg.act(F.col("text"), F.col("n_anchors") > 0).alias("act"), "n_anchors")


_KEPT = f"list_filter(regexp_extract_all(regexp_replace(text, '{dg.HEAD}', ''), '[A-Za-z0-9]+(?:[''’\\-][A-Za-z0-9]+)*'), lambda w: lower(w) NOT IN {_L(dg.FILLERS)})"


@named(
    "built_queries",
    f"WITH k AS (SELECT conv_id, turn, {_KEPT} AS ws FROM conversations), p AS (SELECT *, list_position(list_transform(ws, lambda w: lower(w) NOT IN {_L(dg.GREETINGS + dg.CONTINUERS + dg.LEADS)}), true) AS b, "
    f"list_position(list_reverse(list_transform(ws, lambda w: lower(w) NOT IN {_L(dg.DANGLING)} OR lower(w) IN {_L(dg.NEGATIONS + dg.AUX_FIRST)})), true) AS r FROM k), q AS (SELECT *, len(ws) - r + 1 AS e FROM p) "
    "SELECT conv_id, turn, sha1(CASE WHEN coalesce(b, 0) > 0 AND coalesce(r, 0) > 0 AND e >= b THEN array_to_string(ws[b:e], ' ') ELSE '' END) AS digest FROM q",
)
def built_queries(t):
    return t.conversations.select("conv_id", "turn", F.sha1(dg.build_query(F.col("text"))).alias("digest"))


_SIM = (
    "n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM (SELECT conv_id, turn, list_distinct(" + sql_terms("text") + ") AS terms FROM conversations)), "
    "sm AS (SELECT a.conv_id, a.turn, round(max(CASE WHEN b.turn IS NULL THEN 0.0 WHEN len(list_distinct(list_concat(a.terms, b.terms))) = 0 THEN 1.0 ELSE len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))) END), 6) AS similarity "
    "FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id AND b.pos < a.pos GROUP BY ALL)"
)
_DECIDE = (
    f"{SAID}, {_SIM}, x AS (SELECT c.conv_id, c.turn, c.text, {act_sql('c.text', '(coalesce(s.n_anchors, 0) > 0)')} AS act, coalesce(s.n_terms, 0) AS n_terms, coalesce(s.n_anchors, 0) AS n_anchors, least(1.0, coalesce(s.max_idf, 0) / norm.norm) AS strength, 1 - m.similarity AS novelty FROM conversations c LEFT JOIN st s USING (conv_id, turn) JOIN sm m USING (conv_id, turn) CROSS JOIN norm), "
    "y AS (SELECT *, round(0.35 + 0.20 * least(1.0, n_terms / 3.0) + 0.20 * CASE WHEN n_anchors > 0 THEN 1 ELSE 0 END + 0.15 * CASE WHEN act = 'INFO_REQUEST' THEN 1.0 ELSE 0.5 END + 0.10, 3) AS stability, "
    f"round(least(1.0, CASE act WHEN 'INFO_REQUEST' THEN 0.55 WHEN 'UNKNOWN' THEN 0.2 ELSE 0.0 END + 0.25 * strength + 0.10 * least(n_anchors, 3) / 3.0 + CASE WHEN act = 'INFO_REQUEST' AND (contains(text, '?') OR {_any(_WORDS.format('text'), dg.QUESTION_WORDS)}) THEN 0.10 ELSE 0 END), 3) AS worth FROM x)"
)


@named(
    "controller_final",
    f"WITH {_DECIDE} SELECT conv_id, turn, act, stability, worth, CASE WHEN act IN ('PRESENTATION', 'SOCIAL', 'BACKCHANNEL', 'META') THEN 'suppressed_act' WHEN n_terms = 0 THEN 'empty_content' WHEN act <> 'INFO_REQUEST' AND worth < 0.5 THEN 'not_worthy' WHEN novelty < 0.25 THEN 'redundant' ELSE 'worthy_request' END AS reason FROM y",
)
def controller_final(t):
    """The decision at the end of every utterance."""
    rows = turns(t).withColumn("act", dg.act(F.col("text"), F.col("n_anchors") > 0))
    sims = state.recent_similarity(t.conversations.select("conv_id", "turn", tx.terms(F.col("text")).alias("terms")), "conv_id", "turn", least=1 - CONTROLLER.novelty_threshold)
    full = rows.withColumn("persistence", F.lit(1.0)).withColumn("final", F.lit(True)).join(sims, ["conv_id", "turn"])
    judged = dg.signals(full, anchor_norm(t))
    _, reason = dg.gate(1 - F.col("similarity"))
    return judged.select("conv_id", "turn", "act", "stability", "worth", reason.alias("reason"))


def provisional_ticks(t):
    """Every eight words one tick; the whole utterance is the final one.

    A tick holds its piece and the words ahead of it in which a phrase can begin; only the final tick holds the whole text, so the
    rows grow with the text and not with its square.  ``copy`` numbers the rows of one utterance.
    """
    same = Window.partitionBy("session", "utterance").orderBy("text")
    rows = t.conversations.where("text IS NOT NULL").select(F.col("conv_id").alias("session"), F.col("turn").alias("utterance"), "text")
    pieces = F.transform(corpus.word_windows(F.col("text"), 8, 0), lambda w: w["text"])

    def cut(ps):
        last = F.size(ps) - 1
        return F.transform(
            ps,
            lambda p, i: F.struct(
                i.alias("tick"),
                (i == last).alias("final"),
                F.when(i == last, F.col("text")).otherwise(p).alias("text"),
                F.when(i < last, F.substring_index(F.get(ps, i - 1), " ", -dg.LOOKBACK)).alias("before"),
            ),
        )

    numbered = dealt(rows, "session", "utterance").withColumn("copy", F.row_number().over(same))
    ticks = numbered.select("session", "utterance", "copy", F.explode_outer(tx.let(pieces, cut)).alias("at")).where("at IS NOT NULL")
    return ticks.select(
        "session", "utterance", "copy", "at.tick", (F.col("at.tick") * 250 + 250).alias("at_ms"), "at.final", "at.text", "at.before"
    ).withColumn("terms", tx.terms(F.col("text")))


@named("controller_ticks")
def controller_ticks(t):
    """Retrieve, wait or skip at every tick of every utterance, within the utterance's budget and cooldown."""
    keys = ["session", "utterance", "copy", "tick"]
    ticks = dg.so_far(provisional_ticks(t), keys[:-1]).drop("text", "before")
    rows = term_signals(ticks, t, keys, grows=True).withColumn("act", dg.act(dg.said(), F.col("n_anchors") > 0))
    judged = dg.signals(rows.withColumn("persistence", F.when(F.col("final"), 1.0).otherwise(0.5)), anchor_norm(t), dg.said())
    decision, reason = dg.gate(F.lit(1.0))
    return dg.spend_budget(judged.withColumn("decision", decision).withColumn("reason", reason), grows=True)


@named(
    "baseline_policies",
    "WITH p AS (SELECT conv_id, turn, CAST(ceil(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) / 8) AS BIGINT) AS n FROM conversations) SELECT conv_id, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS end_only, CAST(sum(n) AS BIGINT) AS every_chunk FROM p GROUP BY conv_id",
)
def baseline_policies(t):
    """Searches two simple policies would issue: once per utterance, or once per piece."""
    n = F.ceil(F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+")) / 8)
    return t.conversations.select("conv_id", n.alias("n")).groupBy("conv_id").agg(
        F.count_if(F.col("n") > 0).alias("end_only"), F.sum("n").alias("every_chunk")
    )


# --- intents ----------------------------------------------------------------------------------------------------


def drafts(t):
    """(session, utterance, ord, clause, role, terms, n_terms, n_anchors, max_idf, n_drafts, n_constraints)."""
    rows = t.conversations.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("utterance"), F.posexplode(dg.clauses(F.col("text"))).alias("ord", "clause")
    ).select("*", dg.clause_role(F.col("clause")).alias("role"), tx.terms(F.col("clause")).alias("terms"))
    keys = ["session", "utterance", "ord"]
    full = term_signals(rows, t, keys)
    counts = full.groupBy("session", "utterance").agg(
        F.count_if((F.col("role") != "constraint") & (F.col("n_anchors") > 0)).alias("n_drafts"),
        F.count_if(F.col("role") == "constraint").alias("n_constraints"),
    )
    return full.join(counts, ["session", "utterance"])


def needs_only(rows):
    return rows.where((F.col("role") != "constraint") & (F.col("n_anchors") > 0))


_OPEN = "|".join(dg.QUESTION_WORDS + dg.AUX_FIRST)
_CUT = f"regexp_replace(regexp_replace(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), '\\s+(?:and|plus|but)\\s+((?:{_OPEN})\\b)', chr(10) || '\\1', 'g')"
_FIRST = _WORDS.format("clause") + "[1]"
_ROLE = (
    f"CASE WHEN {_phr('clause', dg.CORRECTIONS)} THEN 'correction' WHEN contains(clause, '?') OR {_any(_WORDS.format('clause'), dg.QUESTION_WORDS)} OR coalesce({_FIRST}, '') IN {_L(dg.AUX_FIRST)} THEN 'request' "
    f"WHEN {_phr('clause', dg.REQUEST_HEADS)} THEN 'request' WHEN coalesce({_FIRST}, '') IN {_L(dg.RESTRICTIONS)} THEN 'constraint' ELSE 'narrative' END"
)
DRAFTS = (
    f"{DOC_TERMS}, {_IDF}, {NORM}, cl0 AS (SELECT conv_id AS session, turn AS utterance, list_filter(list_transform(string_split({_CUT}, chr(10)), lambda p: trim(p)), lambda p: regexp_matches(p, '[A-Za-z0-9]')) AS ps FROM conversations), "
    f"cl AS (SELECT session, utterance, unnest(ps) AS clause, generate_subscripts(ps, 1) - 1 AS ord FROM cl0), dr0 AS (SELECT *, {_ROLE} AS role, list_distinct({sql_terms('clause')}) AS terms FROM cl), "
    "dx AS (SELECT session, utterance, ord, unnest(terms) AS term FROM dr0), ds AS (SELECT session, utterance, ord, count(*) FILTER (WHERE i.idf >= 1.0) AS na, max(i.idf) FILTER (WHERE i.idf >= 1.0) AS mi FROM dx LEFT JOIN ix i USING (term) GROUP BY ALL), "
    "dr AS (SELECT d.*, coalesce(s.na, 0) AS n_anchors, s.mi AS max_idf FROM dr0 d LEFT JOIN ds s USING (session, utterance, ord)), dc AS (SELECT session, utterance, count(*) FILTER (WHERE role <> 'constraint' AND n_anchors > 0) AS n_drafts, count(*) FILTER (WHERE role = 'constraint') AS n_constraints FROM dr GROUP BY ALL), "
    "sc0 AS (SELECT d.*, c.n_drafts, c.n_constraints, least(1.0, coalesce(d.max_idf, 0) / norm.norm) AS sp, CASE WHEN role = 'request' THEN 1.0 ELSE 0.5 END AS ex FROM dr d JOIN dc c USING (session, utterance) CROSS JOIN norm WHERE d.role <> 'constraint' AND d.n_anchors > 0), "
    f"sc1 AS (SELECT *, 0.35 * ex + 0.30 * sp + 0.20 * CASE WHEN n_drafts = 1 THEN 1.0 ELSE 0.8 END + 0.15 * CASE WHEN {_any(_WORDS.format('clause'), dg.ANAPHORA)} THEN 0.85 ELSE 1.0 END AS raw FROM sc0), "
    "sc AS (SELECT session, utterance, ord, clause, role, terms, round(raw, 3) AS confidence, round(0.35 * raw + 0.25 * sp + 0.15 * ex + CASE WHEN n_constraints > 0 THEN 0.10 ELSE 0 END + 0.10, 3) AS priority_score FROM sc1), "
    "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, utterance ORDER BY priority_score DESC, ord) AS priority FROM sc) WHERE priority <= 4)"
)


@named("clause_roles", f"WITH {DRAFTS} SELECT session, utterance, role, count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM dr GROUP BY ALL")
def clause_roles(t):
    rows = t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("utterance"), F.explode(dg.clauses(F.col("text"))).alias("clause"))
    return rows.groupBy("session", "utterance", dg.clause_role(F.col("clause")).alias("role")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size(tx.terms(F.col("clause")))).alias("n_terms")
    )


def scored_intents(t):
    return dg.intent_scores(needs_only(drafts(t)), anchor_norm(t))


@named("intent_scores", f"WITH {DRAFTS} SELECT session, utterance, ord, role, confidence, priority_score FROM sc")
def intent_scores(t):
    return scored_intents(t).select("session", "utterance", "ord", "role", "confidence", "priority_score")


@named(
    "intent_budget",
    f"WITH {DRAFTS} SELECT session, utterance, ord, row_number() OVER (PARTITION BY session, utterance ORDER BY priority_score DESC, ord) AS priority, sha1(clause) AS digest, "
    "CASE WHEN row_number() OVER (PARTITION BY session, utterance ORDER BY priority_score DESC, ord) <= 4 THEN 'kept' ELSE 'over_budget' END AS outcome FROM sc",
)
def intent_budget(t):
    """Every need with its priority; those beyond the budget stay visible with the reason."""
    return dg.budgeted(scored_intents(t)).select(
        "session", "utterance", "ord", "priority", F.sha1("clause").alias("digest"), "outcome"
    )


@named(
    "intent_relations",
    f"WITH {DRAFTS}, p AS (SELECT a.session, a.utterance, a.ord AS ord_a, b.ord AS ord_b, len(a.terms) AS na, len(b.terms) AS nb, len(list_intersect(a.terms, b.terms)) AS s FROM kept a JOIN kept b ON a.session = b.session AND a.utterance = b.utterance AND a.ord < b.ord) "
    "SELECT session, utterance, ord_a, ord_b, CASE WHEN s / (na + nb - s) >= 0.8 THEN 'duplicate' WHEN s = na AND na < nb THEN 'refines_a' ELSE 'refines_b' END AS relation FROM p WHERE na > 0 AND nb > 0 AND (s / (na + nb - s) >= 0.8 OR (s = na AND na < nb) OR (s = nb AND nb < na))",
)
def intent_relations(t):
    return dg.intent_relations(dg.within_budget(scored_intents(t)))


@named(
    "constraint_scope",
    f"WITH {DRAFTS}, j AS (SELECT k.session, k.utterance, k.ord, i.ord AS intent, list_has_any(k.terms, i.terms) AS sh FROM dr k LEFT JOIN kept i USING (session, utterance) WHERE k.role = 'constraint'), g AS (SELECT session, utterance, ord, count(intent) AS ni, count(*) FILTER (WHERE sh) AS ns, count(*) FILTER (WHERE intent < ord) AS nb FROM j GROUP BY ALL) "
    "SELECT session, utterance, ord, CASE WHEN ns = 1 THEN 1 ELSE ni END AS n_applies, CASE WHEN ni = 0 THEN 'no_intent' WHEN ns = 1 THEN 'shares_term_with_one_intent' WHEN nb > 0 THEN 'restriction_applies_to_request' ELSE 'fronted_restriction' END AS reason, CAST(CASE WHEN ni <= 1 THEN 1.0 WHEN ns = 1 THEN 0.9 WHEN nb > 0 THEN 0.6 ELSE 1.0 END AS DOUBLE) AS confidence FROM g",
)
def constraint_scope(t):
    constraints = drafts(t).where("role = 'constraint'").select("session", "utterance", "ord", "terms")
    return dg.scope(constraints, dg.within_budget(scored_intents(t)))


@named(
    "phrase_match",
    f"SELECT conv_id, turn, len(regexp_extract_all(lower(text), '\\b(?:{'|'.join(sorted(dg.REQUEST_HEADS + ['of the', 'in the', 'it is'], key=lambda p: (-len(p.split()), p)))})\\b')) AS n FROM conversations",
)
def phrase_match(t):
    hits = dg.phrase_hits(F.col("text"), dg.REQUEST_HEADS + ["of the", "in the", "it is"])
    return t.conversations.select("conv_id", "turn", F.size(hits).alias("n"))


@named(
    "span_validation",
    "WITH s AS (SELECT conv_id, turn, text, unnest(list_transform(regexp_extract_all(text, '[^.!?]+'), lambda x: trim(x))) AS piece FROM conversations) SELECT conv_id, count(*) AS n_spans, count(*) FILTER (WHERE NOT contains(text, piece)) AS n_broken FROM s WHERE piece <> '' GROUP BY conv_id",
)
def span_validation(t):
    """Every quoted span must be a slice of what was said."""
    pieces = F.transform(F.regexp_extract_all("text", F.lit(r"[^.!?]+"), 0), lambda x: F.trim(x))
    rows = t.conversations.select("conv_id", "text", F.explode(pieces).alias("piece")).where("piece <> ''")
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.count_if(~F.contains("text", "piece")).alias("n_broken")
    )
