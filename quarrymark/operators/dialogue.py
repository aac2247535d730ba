"""From spoken text to needs: dialogue acts, query building, retrieval decisions, intents.

Rules over word arrays of one utterance; corpus statistics come in by joins on terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.config import CONTROLLER, FUSION
from quarrymark.functions import lexicon
from quarrymark.functions.text import GUARD_NEGATIONS, let

FILLERS = "ah eh er erm hm hmm uh uhm um umm basically honestly literally".split()
GREETINGS = "bye cheers goodbye great hello hey hi lovely morning thank thanks welcome".split()
CONTINUERS = "aha alright fine mhm ok okay right sure yeah yep yes".split()
QUESTION_WORDS = lexicon.ASKERS
AUX_FIRST = lexicon.AUXILIARIES
DANGLING = lexicon.ARTICLES + lexicon.PREPOSITIONS + lexicon.CONJUNCTIONS
LEADS = lexicon.CONJUNCTIONS + ["about", "also", "now", "then"]
REWORK = "repeat rephrase reword shorten simplify summarise summarize translate".split()
REWORK_OBJECTS = lexicon.PERSONS + lexicon.POINTERS + "again answer please previous reply shorter simpler text".split()
ANAPHORA = lexicon.POINTERS + "it its one ones they them their".split()
REQUEST_HEADS = [
    *lexicon.phrases("can you|could you|would you|will you|please|", "tell|show", "me"),
    *lexicon.phrases("can you|could you|would you|please", "explain|describe"),
    *lexicon.phrases("i", "want|need|would like", "to", "know|find out"),
]
META_PHRASES = [*lexicon.phrases("which|what", "sources|documents|references"), *lexicon.phrases("what did i", "ask|say")]
MORE_PHRASES = ["more detail", "more details", "say more", *lexicon.phrases("tell|show", "me more")]
NEGATIONS = GUARD_NEGATIONS
RESTRICTIONS = "after before during except for if only unless until when while within without".split()
CORRECTIONS = [*lexicon.phrases("i", "meant|mean", "instead|"), "scratch that", "no wait", "let me correct"]

WORD = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"
# a request head, possibly after hesitation and greetings
HEAD = r"(?i)^(?:[^A-Za-z0-9]*\b(?:" + "|".join(FILLERS + GREETINGS + CONTINUERS) + r")\b)*[^A-Za-z0-9]*(?:" + lexicon.longest_first(REQUEST_HEADS) + r")\b"
SUPPRESSED = {"PRESENTATION": 0.9, "SOCIAL": 0.85, "BACKCHANNEL": 0.9, "META": 0.85}


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))


def has_phrase(text: Column, phrases: list[str]) -> Column:
    return F.lower(text).rlike(r"\b(?:" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + r")\b")


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Non-overlapping matches, longest phrase first at every place."""
    ordered = sorted(phrases, key=lambda p: (-len(p.split()), p))
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:" + "|".join(ordered) + r")\b"), 0)


def _every(c: str, seen) -> Column:
    return F.bool_and(c).over(seen)


def _some(c: str, seen) -> Column:
    return F.bool_or(c).over(seen)


def _first(c: str, seen) -> Column:
    return F.first(c, ignorenulls=True).over(seen)


def _last(c: str, seen) -> Column:
    return F.last(c, ignorenulls=True).over(seen)


# How a trait of a text follows from the traits of its pieces in order.
TRAITS = {
    "idle": _every, "more": _some, "meta": _some, "reworks": _some, "plain": _every, "asks": _some, "heads": _some,
    "opens": _first, "greets": _some, "trails": _last, "ended": _last, "comma": _last,
}
# So many words ahead of a piece can belong to a phrase that ends in it.
LOOKBACK = max(len(p.split()) for p in MORE_PHRASES + META_PHRASES + REQUEST_HEADS) - 1


def traits(text: Column, ws: Column | None = None, before: Column | None = None) -> dict[str, Column]:
    """What ``act`` and ``signals`` ask of a text; ``ws`` are its words where a column has them already.

    A piece of a text comes with ``before``, the ``LOOKBACK`` words ahead of it.
    """
    ws = words(text) if ws is None else ws
    only = lambda table: F.forall(ws, lambda w: w.isin(table))
    some = lambda table: F.exists(ws, lambda w: w.isin(table))
    rework_rest = F.filter(ws, lambda w: ~w.isin(REWORK + REWORK_OBJECTS + FILLERS + CONTINUERS + AUX_FIRST))
    first = F.try_element_at(F.filter(ws, lambda w: ~w.isin(FILLERS + GREETINGS + CONTINUERS)), F.lit(1))
    wide = text if before is None else F.concat_ws(" ", before, text)
    return {
        "idle": only(FILLERS + CONTINUERS),
        "more": has_phrase(wide, MORE_PHRASES),
        "meta": has_phrase(wide, META_PHRASES),
        "reworks": some(REWORK),
        "plain": F.size(rework_rest) == 0,
        "asks": text.contains("?") | some(QUESTION_WORDS),
        "heads": has_phrase(wide, REQUEST_HEADS),
        "opens": first.isin(AUX_FIRST),
        "greets": some(GREETINGS),
        "trails": F.try_element_at(ws, F.lit(-1)).isin(DANGLING),
        "ended": text.rlike(r"[.?!]\s*$"),
        "comma": F.rtrim(text).endswith(","),
    }


def so_far(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Add the column ``said``: the traits of all that was said up to a tick, as a struct.

    Needs (tick, final, text, before): ``text`` is the piece of a tick, and the whole text at the final one.
    """
    told = ticks.withColumn("_ws", words(F.col("text")))
    told = told.withColumns({f"_{k}": c for k, c in traits(F.col("text"), F.col("_ws"), F.col("before")).items()})
    seen = Window.partitionBy(*keys).orderBy("tick")
    grown = [F.when(F.col("final"), F.col(f"_{k}")).otherwise(grow(f"_{k}", seen)).alias(k) for k, grow in TRAITS.items()]
    return told.select(*ticks.columns, F.struct(*grown).alias("said"))


def said(column: str = "said") -> dict[str, Column]:
    """The traits in a column of ``so_far``, for ``act`` and ``signals``."""
    return {k: F.col(f"{column}.{k}") for k in TRAITS}


def act(text: Column | dict[str, Column], anchored: Column) -> Column:
    """Dialogue act of a text, or of its traits; first rule that applies.

    ``anchored`` says whether the words name something specific to the corpus.
    """
    it = text if isinstance(text, dict) else traits(text)
    return (
        F.when(it["idle"], "BACKCHANNEL")
        .when(it["more"], "INFO_REQUEST")
        .when(it["meta"] & ~anchored, "META")
        .when(it["reworks"] & it["plain"], "PRESENTATION")
        .when(it["asks"] | it["heads"], "INFO_REQUEST")
        .when(F.coalesce(it["opens"], F.lit(False)), "INFO_REQUEST")
        .when(it["greets"] & ~anchored, "SOCIAL")
        .otherwise("UNKNOWN")
    )


def build_query(text: Column) -> Column:
    """Fillers, leading greetings and request heads, and trailing function words removed; negations never are."""
    headless = F.regexp_replace(text, HEAD, "")
    kept = F.filter(F.regexp_extract_all(headless, F.lit(WORD), 0), lambda w: ~F.lower(w).isin(FILLERS))

    def trim(ws: Column) -> Column:
        lead = F.transform(ws, lambda w: ~F.lower(w).isin(GREETINGS + CONTINUERS + LEADS))
        tail = F.transform(ws, lambda w: ~F.lower(w).isin(DANGLING) | F.lower(w).isin(NEGATIONS + AUX_FIRST))
        begin = F.array_position(lead, F.lit(True)).cast("int")
        end = F.size(ws) - F.array_position(F.reverse(tail), F.lit(True)).cast("int") + 1
        some = (begin > 0) & (F.array_position(tail, F.lit(True)) > 0) & (end >= begin)
        return F.when(some, F.array_join(F.slice(ws, F.greatest(begin, F.lit(1)), F.greatest(end - begin + 1, F.lit(0))), " ")).otherwise("")

    return let(kept, trim)


def signals(rows: DataFrame, norm: Column, it: dict[str, Column] | None = None) -> DataFrame:
    """Stability, worthiness and their inputs.

    Needs (text, act, n_terms, n_anchors, max_idf, persistence, final), and no text where its traits are given; ``norm`` is the
    idf of a term found once.
    """
    c = F.col
    it = it or traits(c("text"))
    dangling = ~it["ended"] & (F.coalesce(it["trails"], F.lit(False)) | it["comma"]) & ~c("final")
    strength = F.least(F.lit(1.0), F.coalesce("max_idf", F.lit(0.0)) / norm)
    ask = c("act") == "INFO_REQUEST"
    base = F.when(ask, 0.55).when(c("act") == "UNKNOWN", 0.2).otherwise(0.0)
    stability = (
        0.35 * F.when(c("dangling"), 0.0).otherwise(1.0)
        + 0.20 * F.least(F.lit(1.0), c("n_terms") / 3.0)
        + 0.20 * F.when(c("n_anchors") > 0, 1.0).otherwise(0.0)
        + 0.15 * F.when(ask, 1.0).otherwise(0.5)
        + 0.10 * c("persistence")
    )
    worth = (
        base
        + 0.25 * c("strength")
        + 0.10 * F.least(c("n_anchors"), F.lit(3)) / 3.0
        + F.when(ask & it["asks"], 0.10).otherwise(0.0)
    )
    return (
        rows.withColumn("dangling", dangling)
        .withColumn("strength", strength)
        .withColumn("stability", F.round(stability, 3))
        .withColumn("worth", F.round(F.least(F.lit(1.0), worth), 3))
    )


def gate(novelty: Column) -> tuple[Column, Column]:
    """(decision, reason) of one tick before budgets: the rules that look at the utterance alone."""
    c = F.col
    cfg = CONTROLLER
    confident = F.lit(False)
    for name, confidence in SUPPRESSED.items():
        confident = confident | ((c("act") == name) & F.lit(confidence >= cfg.suppress_confidence))
    specific = (c("n_anchors") > 0) & ((c("n_terms") >= cfg.min_content_terms) | (c("strength") >= cfg.strong_anchor))
    open_ = ~c("final")
    table = (
        (confident, "SKIP", "suppressed_act"),
        ((c("n_terms") == 0) & c("final"), "SKIP", "empty_content"),
        (c("n_terms") == 0, "WAIT", "no_content"),
        (open_ & c("dangling"), "WAIT", "trailing_function_word"),
        (open_ & ~specific, "WAIT", "low_specificity"),
        (open_ & (c("stability") < cfg.min_stability), "WAIT", "awaiting_stability"),
        (open_ & (c("worth") < cfg.min_worthiness), "WAIT", "not_yet_worthy"),
        (c("final") & (c("act") != "INFO_REQUEST") & (c("worth") < cfg.min_worthiness), "SKIP", "not_worthy"),
        (novelty < cfg.novelty_threshold, "SKIP", "redundant"),
    )
    decision, reason = F.when(F.lit(False), "NONE"), F.when(F.lit(False), "none")
    for test, what, why in table:
        decision, reason = decision.when(test, what), reason.when(test, why)
    return decision.otherwise("RETRIEVE"), reason.otherwise("worthy_request")


BUDGET_SCHEMA = "session long, utterance long, tick int, decision string, reason string"


SPENT = ("session", "utterance", "tick", "at_ms", "final", "terms", "decision", "reason", "copy", "place")


def _spend(batches: Iterator[pa.RecordBatch], grows: bool) -> Iterator[pa.RecordBatch]:
    """Budget, reserve, cooldown and novelty against the queries an utterance already issued; its ticks come in order."""
    cfg = CONTROLLER
    issued: list[frozenset] = []
    heard: dict[int, tuple[set, list[int]]] = {}  # by copy: its words so far, and how many of them each issued query has
    last = None
    for batch in batches:
        decisions, reasons = [], []
        for at_ms, final, terms, decision, reason, copy, place in zip(*(batch.column(c).to_pylist() for c in SPENT[3:]), strict=True):
            if place == 1:
                issued, heard, last = [], {}, None
            shared = None
            if grows and not final:
                known, shared = heard.setdefault(copy, (set(), [0] * len(issued)))
                fresh = set(terms or ()) - known
                known |= fresh
                for i, query in enumerate(issued):
                    shared[i] += len(fresh & query)
            else:
                known = set(terms or ())
            if decision == "RETRIEVE":
                common = [len(known & q) for q in issued] if shared is None else shared
                sim = max((n / (len(known) + len(q) - n) if known or q else 1.0 for n, q in zip(common, issued, strict=True)), default=0.0)
                limit = cfg.max_retrievals - (0 if final else cfg.reserve_final)
                if 1.0 - sim < cfg.novelty_threshold:
                    decision, reason = "SKIP", "redundant"
                elif len(issued) >= limit:
                    decision, reason = ("SKIP", "budget_exhausted") if final else ("WAIT", "provisional_budget_exhausted")
                elif not final and last is not None and at_ms - last < cfg.cooldown_ms:
                    decision, reason = "WAIT", "cooldown"
                else:
                    query = frozenset(known)
                    issued.append(query)
                    last = at_ms
                    for words_, counts in heard.values():
                        counts.append(len(words_ & query))
            decisions.append(decision)
            reasons.append(reason)
        kept = [batch.column(c) for c in SPENT[:3]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(decisions, pa.string()), pa.array(reasons, pa.string())], names=[*SPENT[:3], "decision", "reason"])


def spend_budget(ticks: DataFrame, grows: bool = False) -> DataFrame:
    """Decisions of all ticks of an utterance in order, as one sorted stream.

    The terms of a tick are all terms of its text; with ``grows`` those of its own piece, save at the final tick, and ``copy`` tells
    the texts of one utterance apart.
    """
    order = Window.partitionBy("session", "utterance").orderBy("tick", *(["copy"] if grows else []))
    slim = ticks.select(
        F.col("session").cast("long").alias("session"), F.col("utterance").cast("long").alias("utterance"), F.col("tick").cast("int").alias("tick"),
        "at_ms", "final", "terms", "decision", "reason", (F.col("copy") if grows else F.lit(1)).alias("copy"),
    )
    # the window is what keeps an utterance together and in order
    return slim.withColumn("place", F.row_number().over(order)).mapInArrow(lambda batches: _spend(batches, grows), BUDGET_SCHEMA)


# --- intents ----------------------------------------------------------------------------------------------------


def clauses(text: Column) -> Column:
    """Clauses of an utterance: cut at sentence ends, semicolons, line breaks, and where a coordinator opens a new question."""
    opener = "|".join(QUESTION_WORDS + AUX_FIRST)
    parts = F.split(text, rf"(?<=[.!?;])\s+|\n+|\s+(?:and|plus|but)\s+(?=(?:{opener})\b)")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.rlike(WORD))


def clause_role(clause: Column) -> Column:
    """request, constraint, correction or narrative."""
    ws = words(clause)
    first = F.coalesce(F.try_element_at(ws, F.lit(1)), F.lit(""))
    return (
        F.when(has_phrase(clause, CORRECTIONS), "correction")
        .when(clause.contains("?") | F.exists(ws, lambda w: w.isin(QUESTION_WORDS)) | first.isin(AUX_FIRST), "request")
        .when(has_phrase(clause, REQUEST_HEADS), "request")
        .when(first.isin(RESTRICTIONS), "constraint")
        .otherwise("narrative")
    )


def intent_scores(drafts: DataFrame, norm: Column) -> DataFrame:
    """Confidence and priority of drafts (session, utterance, ord, clause, role, terms, max_idf, n_drafts, n_constraints)."""
    c = F.col
    specificity = F.least(F.lit(1.0), F.coalesce("max_idf", F.lit(0.0)) / norm)
    explicit = F.when(c("role") == "request", 1.0).otherwise(0.5)
    separation = F.when(c("n_drafts") == 1, 1.0).otherwise(0.8)
    resolution = F.when(F.exists(words(c("clause")), lambda w: w.isin(ANAPHORA)), 0.85).otherwise(1.0)
    rows = drafts.withColumn("specificity", specificity).withColumn("explicit", explicit)
    conf = 0.35 * c("explicit") + 0.30 * c("specificity") + 0.20 * separation + 0.15 * resolution
    prio = (
        0.35 * c("raw")
        + 0.25 * c("specificity")
        + 0.15 * c("explicit")
        + F.when(c("n_constraints") > 0, 0.10).otherwise(0.0)
        + 0.10
    )
    return (
        rows.withColumn("raw", conf)
        .withColumn("confidence", F.round("raw", 3))
        .withColumn("priority_score", F.round(prio, 3))
        .drop("raw")
    )


def budgeted(scored: DataFrame, k: int = FUSION.max_intents) -> DataFrame:
    """Every intent of an utterance with its priority and outcome: ``kept``, or ``over_budget`` from rank k + 1 on."""
    order = Window.partitionBy("session", "utterance").orderBy(F.col("priority_score").desc(), "ord")
    placed = scored.withColumn("priority", F.row_number().over(order))
    return placed.withColumn("outcome", F.when(F.col("priority") <= k, "kept").otherwise("over_budget"))


def within_budget(scored: DataFrame, k: int = FUSION.max_intents) -> DataFrame:
    """The intents that the budget keeps."""
    return budgeted(scored, k).where("outcome = 'kept'").drop("outcome")


def intent_relations(intents: DataFrame) -> DataFrame:
    """Duplicates (Jaccard of at least 0.8) and refinements (strict subsets) among the few intents of one utterance."""
    side = lambda s: intents.select("session", "utterance", *[F.col(x).alias(f"{x}_{s}") for x in ("ord", "terms")])
    rows = side("a").join(side("b"), ["session", "utterance"]).where("ord_a < ord_b")
    shared = F.size(F.array_intersect("terms_a", "terms_b"))
    na, nb = F.size("terms_a"), F.size("terms_b")
    kind = (
        F.when((na == 0) | (nb == 0), None)
        .when(shared / (na + nb - shared) >= 0.8, "duplicate")
        .when((shared == na) & (na < nb), "refines_a")
        .when((shared == nb) & (nb < na), "refines_b")
    )
    return rows.withColumn("relation", kind).where("relation IS NOT NULL").select("session", "utterance", "ord_a", "ord_b", "relation")


def scope(constraints: DataFrame, intents: DataFrame) -> DataFrame:
    """(session, utterance, ord, n_applies, reason, confidence): which needs a constraint restricts.

    A word shared with exactly one need binds it there; otherwise it applies to the whole request, with less certainty when
    there are several needs.
    """
    i = intents.select("session", "utterance", F.col("ord").alias("intent"), F.col("terms").alias("it"))
    rows = constraints.join(i, ["session", "utterance"], "left")
    shares = F.arrays_overlap("terms", "it")
    per = rows.groupBy("session", "utterance", "ord").agg(
        F.count("intent").alias("n_intents"),
        F.count_if(shares).alias("n_shared"),
        F.count_if(F.col("intent") < F.col("ord")).alias("n_before"),
    )
    one = F.col("n_shared") == 1
    reason = (
        F.when(F.col("n_intents") == 0, "no_intent")
        .when(one, "shares_term_with_one_intent")
        .when(F.col("n_before") > 0, "restriction_applies_to_request")
        .otherwise("fronted_restriction")
    )
    confidence = (
        F.when(F.col("n_intents") <= 1, 1.0).when(one, 0.9).when(F.col("n_before") > 0, 0.6).otherwise(1.0)
    )
    return per.select(
        "session",
        "utterance",
        "ord",
        F.when(one, F.lit(1)).otherwise(F.col("n_intents")).alias("n_applies"),
        reason.alias("reason"),
        confidence.alias("confidence"),
    )
