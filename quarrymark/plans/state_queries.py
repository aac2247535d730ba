"""Transcripts and versioned state.

Conversations are sessions and turns are utterances.  The chunk stream is every turn in pieces of eight words with the faults a
live feed shows, placed by position: repeats, revisions, late pieces, missing pieces, and one piece after the end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.functions import text as tx
from quarrymark.operators import corpus, lexical, state
from quarrymark.operators import transcripts as tr
from quarrymark.operators.ordered import Split
from quarrymark.plans.corpus_queries import texts_of
from quarrymark.plans.fusion_queries import LISTS, request_lists
from quarrymark.plans.lexical_queries import passages
from quarrymark.plans.registry import named
from quarrymark.plans.sql_parts import BM25, ranked, sql_terms

END = 999_999


def chunk_stream(t):
    """(session, utterance, seq, idx, text)."""
    pieces = t.conversations.select(
        F.col("conv_id").alias("session"),
        F.col("turn").alias("utterance"),
        F.explode(corpus.word_windows(F.col("text"), 8, 0)).alias("w"),
    ).select("session", "utterance", F.col("w.pos").cast("int").alias("idx"), F.col("w.text").alias("text"))
    k = F.col("idx")
    seq = lambda c: c.cast("long").alias("seq")
    arrivals = F.array_compact(
        F.array(
            F.struct(seq(k * 10 + F.when(k % 13 == 9, 25).otherwise(0)), F.col("text").alias("text")),
            F.when(k % 5 == 3, F.struct(seq(k * 10 + 15), F.concat("text", F.lit(" er")).alias("text"))),
            F.when(k % 7 == 2, F.struct(seq(k * 10 + 5), F.col("text").alias("text"))),
            F.when(k == 0, F.struct(seq(F.lit(1_000_000)), F.lit("late").alias("text"))),
        )
    )
    kept = pieces.where(k % 11 != 6).select("session", "utterance", "idx", F.explode(arrivals).alias("a"))
    return kept.select("session", "utterance", "a.seq", "idx", "a.text")


def utterance_ends(t):
    return t.conversations.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("utterance"), F.lit(END).cast("long").alias("end_seq")
    )


CHUNKS = (
    "w AS (SELECT conv_id AS session, turn AS utterance, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS ws FROM conversations), "
    "p0 AS (SELECT session, utterance, ws, unnest(range(0, CAST(ceil(len(ws) / 8) AS BIGINT))) AS idx FROM w), "
    "p AS (SELECT session, utterance, idx, array_to_string(ws[idx * 8 + 1:idx * 8 + 8], ' ') AS text FROM p0 WHERE idx % 11 <> 6), "
    "c AS (SELECT session, utterance, idx, text, idx * 10 + CASE WHEN idx % 13 = 9 THEN 25 ELSE 0 END AS seq FROM p "
    "UNION ALL SELECT session, utterance, idx, text || ' er', idx * 10 + 15 FROM p WHERE idx % 5 = 3 "
    "UNION ALL SELECT session, utterance, idx, text, idx * 10 + 5 FROM p WHERE idx % 7 = 2 "
    "UNION ALL SELECT session, utterance, idx, 'late', 1000000 FROM p WHERE idx = 0)"
)
FOLD = f"{CHUNKS}, f AS (SELECT session, utterance, idx, arg_max(text, seq) AS text, count(*) AS n_arrivals FROM c WHERE seq < 999999 GROUP BY ALL)"


@named(
    "chunk_statuses",
    f"WITH {CHUNKS}, j AS (SELECT *, lag(text) OVER (PARTITION BY session, utterance, idx ORDER BY seq) AS prev, coalesce(max(idx) OVER (PARTITION BY session, utterance ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM c WHERE seq < 999999) "
    "SELECT session, utterance, seq, idx, CASE WHEN prev = text THEN 'duplicate' WHEN prev IS NOT NULL THEN 'revision' WHEN trim(text) = '' THEN 'empty' WHEN idx < top THEN 'out_of_order' WHEN idx > top + 1 THEN 'gap' ELSE 'accepted' END AS status FROM j "
    "UNION ALL SELECT session, utterance, seq, idx, 'rejected_finalized' FROM c WHERE seq >= 999999",
)
def chunk_statuses(t):
    return tr.statuses(chunk_stream(t), utterance_ends(t)).select("session", "utterance", "seq", "idx", "status")


@named("chunk_fold_latest", f"WITH {FOLD} SELECT session, utterance, idx, sha1(text) AS digest, n_arrivals FROM f")
def chunk_fold_latest(t):
    return tr.fold_latest(chunk_stream(t), utterance_ends(t)).select(
        "session", "utterance", "idx", F.sha1("text").alias("digest"), "n_arrivals"
    )


@named(
    "missing_indices",
    f"WITH {FOLD}, m AS (SELECT session, utterance, max(idx) AS top, list(idx) AS have FROM f GROUP BY ALL) SELECT session, utterance, array_to_string(list_filter(range(0, top + 1), lambda i: NOT list_contains(have, i)), ',') AS missing FROM m",
)
def missing_indices(t):
    rows = tr.transcripts(tr.fold_latest(chunk_stream(t), utterance_ends(t)))
    return rows.select("session", "utterance", F.array_join(F.transform("missing", lambda i: i.cast("string")), ",").alias("missing"))


@named(
    "transcript_assemble",
    f"WITH {FOLD} SELECT session, utterance, sha1(string_agg(text, ' ' ORDER BY idx)) AS digest, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS n_chars FROM f GROUP BY ALL",
)
def transcript_assemble(t):
    rows = tr.transcripts(tr.fold_latest(chunk_stream(t), utterance_ends(t)))
    return rows.select("session", "utterance", F.sha1("transcript").alias("digest"), F.length("transcript").alias("n_chars"))


@named(
    "coalesce_revisions",
    f"WITH {CHUNKS}, l AS (SELECT *, max(seq) OVER (PARTITION BY session, utterance, idx) AS last FROM c) SELECT session, utterance, seq, idx FROM l WHERE seq = last OR (seq < 999999 AND 999999 < last)",
)
def coalesce_revisions(t):
    return tr.coalesced(chunk_stream(t), utterance_ends(t)).select("session", "utterance", "seq", "idx")


@named(
    "ordered_release_gaps",
    f"WITH {CHUNKS}, a AS (SELECT session, utterance, idx, min(seq) AS arrived, count(*) AS n FROM c GROUP BY ALL) "
    "SELECT session, utterance, idx, least(max(arrived) OVER (w ROWS UNBOUNDED PRECEDING) - arrived, 20) AS wait, idx > coalesce(lag(idx) OVER w, -1) + 1 AS after_gap, n - 1 AS repeats FROM a WINDOW w AS (PARTITION BY session, utterance ORDER BY idx)",
)
def ordered_release_gaps(t):
    return tr.release_waits(chunk_stream(t), hold=20)


@named(
    "arrival_times",
    f"WITH {CHUNKS} SELECT session, utterance, idx, seq, round(sum(len(string_split(text, ' ')) / 2.5) OVER (PARTITION BY session, utterance ORDER BY idx, seq ROWS UNBOUNDED PRECEDING), 6) AS at_s FROM c",
)
def arrival_times(t):
    """When each piece is said at 2.5 words a second."""
    from pyspark.sql import Window

    w = Window.partitionBy("session", "utterance").orderBy("idx", "seq").rowsBetween(Window.unboundedPreceding, 0)
    words = F.size(F.split("text", " "))
    return chunk_stream(t).select("session", "utterance", "idx", "seq", F.round(F.sum(words / 2.5).over(w), 6).alias("at_s"))


@named(
    "transcript_window",
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations) SELECT conv_id, turn, rk <= 6 AS verbatim, CASE WHEN rk <= 6 THEN CAST(length(text) AS VARCHAR) ELSE sha1(text) END AS kept FROM o",
)
def transcript_window(t):
    """The last six utterances stay verbatim, older ones are kept as a digest."""
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("string").alias("n"), F.sha1("text").alias("h"))
    ends = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    placed = Split(["conv_id"], ["turn"], F.floor(F.col("turn") / 64)).position(rows, "pos")
    from quarrymark.operators.joins import attach

    recent = F.col("n_turns") - F.col("pos") < 6
    joined = attach(placed, ends, ["conv_id"], count="n_turns")
    return joined.select("conv_id", "turn", recent.alias("verbatim"), F.when(recent, F.col("n")).otherwise(F.col("h")).alias("kept"))


# --- queries of a session ---------------------------------------------------------------------------------------

TURNS = f"q AS (SELECT conv_id, turn, list_distinct({sql_terms('text')}) AS terms FROM conversations)"


def session_queries(t):
    return t.conversations.select("conv_id", "turn", tx.terms(F.col("text")).alias("terms"))


def turn_bucket():
    return F.floor(F.col("turn") / 64)


@named(
    "ledger_lineage",
    f"WITH {TURNS}, l AS (SELECT *, row_number() OVER w AS version, lag(terms) OVER w AS pt, lag(turn) OVER w AS supersedes, lead(turn) OVER w AS superseded_by, first_value(turn) OVER w AS root FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
    "SELECT conv_id, turn, version, CASE WHEN pt IS NULL THEN 'initial' WHEN len(pt) > 0 AND len(list_intersect(pt, terms)) / len(pt) >= 0.6 THEN 'refines' ELSE 'replaces' END AS relation, supersedes, superseded_by, superseded_by IS NOT NULL AS stale, root FROM l",
)
def ledger_lineage(t):
    return state.lineage(session_queries(t), "conv_id", "turn", turn_bucket()).drop("terms")


@named(
    "recent_similarity",
    f"WITH {TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM q), s AS (SELECT a.conv_id, a.turn, b.turn AS other, b.pos AS bp, "
    "CASE WHEN b.turn IS NULL THEN 0.0 WHEN len(list_distinct(list_concat(a.terms, b.terms))) = 0 THEN 1.0 ELSE len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))) END AS s "
    "FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id AND b.pos < a.pos) "
    "SELECT conv_id, turn, round(max(s), 6) AS similarity, CASE WHEN max(s) > 0 THEN arg_max(other, (s, -bp)) END AS most_similar FROM s GROUP BY ALL",
)
def recent_similarity(t):
    return state.recent_similarity(session_queries(t), "conv_id", "turn")


KEYS = f"{TURNS}, k AS (SELECT conv_id, turn, terms, left(sha1('documents|k=10|' || array_to_string(list_sort(terms), ' ')), 16) AS key FROM q)"


def keyed(t):
    return session_queries(t).withColumn("key", state.semantic_key(F.col("terms"), "documents", "k=10")).drop("terms")


@named(
    "semantic_cache_hits",
    f"WITH {KEYS}, p AS (SELECT key, min((conv_id, turn)) AS src FROM k GROUP BY key) SELECT k.conv_id, k.turn, k.key, p.src[1] AS source_conv, p.src[2] AS source_turn, (k.conv_id, k.turn) > p.src AS hit FROM k JOIN p USING (key)",
)
def semantic_cache_hits(t):
    found = state.cache_lookup(keyed(t), "key", F.struct("conv_id", "turn"))
    return found.select(
        "conv_id", "turn", "key", F.col("source.conv_id").alias("source_conv"), F.col("source.turn").alias("source_turn"), "hit"
    )


@named(
    "delta_plan",
    f"WITH {KEYS}, p AS (SELECT key, min((conv_id, turn)) AS src FROM k GROUP BY key), a AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY turn) AS ak FROM k) "
    "SELECT a.conv_id, a.turn, CASE WHEN ak = a.key THEN 'reuse_active' WHEN (a.conv_id, a.turn) > p.src THEN 'cache_hit' ELSE 'retrieve' END AS action, coalesce(ak <> a.key, false) AS supersedes_active FROM a JOIN p USING (key)",
)
def delta_plan(t):
    plan = state.delta_plan(keyed(t), "conv_id", "turn", turn_bucket(), F.struct("conv_id", "turn"))
    return plan.select("conv_id", "turn", "action", F.coalesce("supersedes_active", F.lit(False)).alias("supersedes_active"))


@named(
    "semi_ledger_hit",
    f"WITH {TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM q) SELECT a.conv_id, a.turn FROM n a WHERE EXISTS (SELECT 1 FROM n b WHERE b.conv_id = a.conv_id AND b.pos < a.pos "
    "AND len(list_intersect(a.terms, b.terms)) >= 0.8 * len(list_distinct(list_concat(a.terms, b.terms))))",
)
def semi_ledger_hit(t):
    """Turns that an earlier query of the conversation answers well enough (Jaccard of at least 0.8)."""
    sims = state.recent_similarity(session_queries(t), "conv_id", "turn", least=0.8)
    return sims.where("most_similar IS NOT NULL").select("conv_id", "turn")


@named(
    "semantic_diff",
    f"WITH {TURNS}, p AS (SELECT *, lag(terms) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM q) SELECT conv_id, turn, len(list_filter(terms, lambda x: NOT list_contains(coalesce(old, []), x))) AS n_added, len(list_filter(coalesce(old, []), lambda x: NOT list_contains(terms, x))) AS n_removed, "
    "CASE WHEN old IS NULL THEN 'NEW_INTENT' WHEN len(list_filter(old, lambda x: NOT list_contains(terms, x))) = 0 THEN 'REFINEMENT' WHEN NOT list_has_any(old, terms) THEN 'ENTITY_CHANGE' WHEN len(old) <> len(terms) THEN 'QUESTION_CHANGE' ELSE 'REFINEMENT' END AS change FROM p",
)
def semantic_diff(t):
    """Terms a turn adds and drops, and the kind of change (a different number of terms stands for a changed aspect)."""
    rows = Split(["conv_id"], ["turn"], turn_bucket()).lag(session_queries(t), old="terms")
    old = F.coalesce("old", F.array().cast("array<string>"))
    minus = F.array_except(old, F.col("terms"))
    no = F.lit(False)
    kind = state.change_type(
        no, F.col("old").isNull(), no, no, no, minus, F.arrays_overlap(old, F.col("terms")), F.size(old) != F.size("terms")
    )
    return rows.select(
        "conv_id", "turn", F.size(F.array_except("terms", old)).alias("n_added"), F.size(minus).alias("n_removed"), kind.alias("change")
    )


@named(
    "version_diff",
    f"WITH tt AS (SELECT conv_id, turn, unnest({sql_terms('text')}) AS term FROM conversations), c AS (SELECT conv_id, turn, term, count(*) AS n FROM tt GROUP BY ALL), "
    "v AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations), n AS (SELECT c.conv_id, v.pos, c.term, c.n FROM c JOIN v USING (conv_id, turn)), "
    "m AS (SELECT conv_id, max(pos) AS last FROM v GROUP BY conv_id), o AS (SELECT n.conv_id, n.pos + 1 AS pos, n.term, n.n FROM n JOIN m USING (conv_id) WHERE n.pos < m.last), "
    "d AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pos, b.pos) AS version, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'retracted' WHEN a.n = b.n THEN 'kept' ELSE 'modified' END AS change FROM o a FULL OUTER JOIN n b ON a.conv_id = b.conv_id AND a.pos = b.pos AND a.term = b.term) "
    "SELECT conv_id, version, change, count(*) AS n FROM d GROUP BY ALL",
)
def version_diff(t):
    """Every turn is a version of its conversation; its terms are the claims, their counts the values."""
    rows = t.conversations.select("conv_id", "turn", lexical.analyse(F.col("text")).alias("ts"))
    placed = Split(["conv_id"], ["turn"], turn_bucket()).position(rows, "pos")
    counts = placed.select("conv_id", "pos", F.explode("ts").alias("term")).groupBy("conv_id", "pos", "term").agg(F.count(F.lit(1)).alias("n"))
    last = placed.groupBy("conv_id").agg(F.max("pos").alias("last"), F.count(F.lit(1)).alias("rows"))
    from quarrymark.operators.joins import attach

    old = attach(counts, last, ["conv_id"], count="rows").where("pos < last").select("conv_id", (F.col("pos") + 1).alias("pos"), "term", "n")
    diff = state.version_diff(old, counts, ["conv_id", "pos", "term"], "n")
    return diff.groupBy("conv_id", F.col("pos").alias("version"), "change").agg(F.count(F.lit(1)).alias("n"))


@named(
    "multiset_equal",
    "SELECT l_orderkey, list_sort(list(l_linenumber)) = range(1, count(*) + 1) AS complete FROM lineitem GROUP BY l_orderkey",
)
def multiset_equal(t):
    """Line numbers of an order against 1..n, as multisets: value counts agree and nothing is left over."""
    per = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c"))
    sums = per.groupBy("l_orderkey").agg(
        F.sum("c").alias("n"), F.max("c").alias("m"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi")
    )
    return sums.select("l_orderkey", ((F.col("m") == 1) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))).alias("complete"))


# --- evidence of a need -----------------------------------------------------------------------------------------

_KINDS = ["CONSTRAINT_ADDITION", "CONSTRAINT_REMOVAL", "REFINEMENT", "QUESTION_CHANGE", "ENTITY_CHANGE", "INTENT_REMOVAL", "CORRECTION"]
_STATUSES = ["ACTIVE", "RETAINED", "REVALIDATION_REQUIRED"]
_CH = (
    f"{BM25}, {ranked(10)}, need AS (SELECT item_id AS qid, list_sort(list_distinct({sql_terms('text')})) AS ts, ["
    + ", ".join(f"'{k}'" for k in _KINDS)
    + "][item_id % 7 + 1] AS change FROM benchmark), ev AS (SELECT r.qid, r.doc_id, r.rank, n.change, n.ts[1:2] AS k, n.ts[3:4] AS a, n.ts[4:6] AS tp, list_distinct(d.toks) AS e, ["
    + ", ".join(f"'{k}'" for k in _STATUSES)
    + "][r.doc_id % 3 + 1] AS status FROM ranked r JOIN need n USING (qid) JOIN doc_terms d USING (doc_id)), "
    "u AS (SELECT *, status IN ('ACTIVE', 'RETAINED') OR (change IN ('CORRECTION', 'INTENT_REMOVAL') AND status = 'REVALIDATION_REQUIRED') AS usable, len(k) > 0 AND list_has_all(e, k) AS cov, list_contains(e, k[-1]) AS head, list_has_any(e, a) AS ra, list_has_any(e, tp) AS rt, list_has_any(a, tp) AS meets FROM ev), "
    "life AS (SELECT qid, doc_id, rank, change, status, CASE WHEN NOT usable THEN status WHEN change = 'CONSTRAINT_ADDITION' THEN CASE WHEN cov THEN 'ACTIVE' WHEN head THEN 'REVALIDATION_REQUIRED' ELSE 'RETAINED' END "
    "WHEN change = 'CONSTRAINT_REMOVAL' THEN CASE WHEN cov THEN 'REVALIDATION_REQUIRED' ELSE 'RETAINED' END WHEN change = 'REFINEMENT' THEN CASE WHEN ra THEN 'ACTIVE' WHEN meets AND NOT rt THEN 'REVALIDATION_REQUIRED' ELSE 'RETAINED' END "
    "WHEN change = 'QUESTION_CHANGE' THEN 'REVALIDATION_REQUIRED' WHEN change = 'ENTITY_CHANGE' THEN CASE WHEN rt THEN 'REVALIDATION_REQUIRED' ELSE 'SUPERSEDED' END WHEN change = 'CORRECTION' THEN 'SUPERSEDED' ELSE 'STALE' END AS new_status, change = 'CORRECTION' AND rt AS carried FROM u)"
)


def assignments(t):
    """Evidence of every passage with a change of the need that depends on the passage's own terms."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    needs = t.benchmark.select(
        F.col("item_id").alias("qid"),
        F.array_sort(tx.terms(F.col("text"))).alias("ts"),
        pick(_KINDS, F.col("item_id") % 7 + 1).alias("change"),
    )
    hits = lexical.bm25_top(t.index, passages(t), k=10).select("qid", "doc_id", "rank")
    docs = texts_of(t, hits).select("doc_id", tx.terms(F.col("text")).alias("e"))
    return hits.join(docs, "doc_id").join(needs, "qid").withColumn("status", pick(_STATUSES, F.col("doc_id") % 3 + 1))


def changed(t):
    new, rule = state.lifecycle(
        F.col("change"), F.col("e"), F.slice("ts", 1, 2), F.slice("ts", 3, 2), F.slice("ts", 4, 3), F.col("status")
    )
    carried = state.carried(F.col("change"), F.col("e"), F.slice("ts", 4, 3))
    return assignments(t).select("qid", "doc_id", "rank", "change", "status", new.alias("new_status"), rule.alias("rule"), carried.alias("carried"))


@named("evidence_lifecycle", f"WITH {_CH} SELECT qid, doc_id, change, status, new_status, carried FROM life")
def evidence_lifecycle(t):
    return changed(t).select("qid", "doc_id", "change", "status", "new_status", "carried")


@named(
    "evidence_confirmed",
    f"WITH {_CH} SELECT qid, doc_id, CASE WHEN new_status = 'REVALIDATION_REQUIRED' THEN CASE WHEN rank <= 5 THEN 'ACTIVE' ELSE 'STALE' END ELSE new_status END AS final_status, "
    "CASE WHEN new_status IN ('ACTIVE', 'RETAINED') OR (new_status = 'REVALIDATION_REQUIRED' AND rank <= 5) THEN 'RETAIN' ELSE 'SUPERSEDE' END AS decision FROM life",
)
def evidence_confirmed(t):
    """The delta retrieval brings back the first five."""
    final = state.confirmed(F.col("new_status"), F.col("rank") <= 5)
    return changed(t).select("qid", "doc_id", final.alias("final_status")).withColumn("decision", state.decision(F.col("final_status")))


@named(
    "drop_unconfirmed",
    f"WITH {LISTS} SELECT uid, item, bool_and(intent_ord < 2) AS stale, count(*) AS n_queries FROM lists GROUP BY ALL",
)
def drop_unconfirmed(t):
    """The last need of a request is the current one; evidence only the earlier ones found is stale."""
    return request_lists(t).groupBy("uid", "item").agg(
        F.bool_and(F.col("intent_ord") < 2).alias("stale"), F.count(F.lit(1)).alias("n_queries")
    )


@named(
    "entity_registry",
    f"WITH {TURNS}, k AS (SELECT conv_id, turn, array_to_string(list_sort(terms), ' ') AS key FROM q) SELECT key, min(conv_id) AS first_conv, max(conv_id) AS last_conv, count(*) AS n_mentions, count(DISTINCT conv_id) AS n_sessions FROM k GROUP BY key",
)
def entity_registry(t):
    """First and last session that named an entity (all its terms, sorted)."""
    key = F.array_join(F.array_sort("terms"), " ")
    return session_queries(t).groupBy(key.alias("key")).agg(
        F.min("conv_id").alias("first_conv"),
        F.max("conv_id").alias("last_conv"),
        F.count(F.lit(1)).alias("n_mentions"),
        F.countDistinct("conv_id").alias("n_sessions"),
    )


@named(
    "snapshot_versions",
    "WITH s AS (SELECT conv_id, turn, sha1(role || text) AS h, lag(sha1(role || text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, CAST(sum(CASE WHEN p IS NULL OR p <> h THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM s",
)
def snapshot_versions(t):
    """A new version only when the snapshot's digest changed."""
    digest = F.sha1(F.concat("role", "text"))
    split = Split(["conv_id"], ["turn"], turn_bucket())
    rows = split.lag(t.conversations.select("conv_id", "turn", digest.alias("h")), p="h")
    fresh = F.when(F.col("p").isNull() | (F.col("p") != F.col("h")), 1).otherwise(0).cast("long")
    return split.running_sum(rows, "version", fresh).select("conv_id", "turn", "version")
