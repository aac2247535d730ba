"""Dialogue rules on hand-made English."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrymark.operators import dialogue as dg


def one(spark, column, text):
    return spark.createDataFrame([(text,)], ["t"]).select(column).first()[0]


@pytest.mark.parametrize(
    "text, anchored, want",
    [
        ("um okay", False, "BACKCHANNEL"),
        ("", False, "BACKCHANNEL"),
        ("tell me more", False, "INFO_REQUEST"),
        ("which sources did you use", False, "META"),
        ("which documents do seniors need", True, "INFO_REQUEST"),
        ("please repeat that", False, "PRESENTATION"),
        ("can you tell me the parking fee", True, "INFO_REQUEST"),
        ("is parking free", True, "INFO_REQUEST"),
        ("thanks that is great", False, "SOCIAL"),
        ("the bus left", True, "UNKNOWN"),
    ],
)
def test_acts(spark, text, anchored, want):
    assert one(spark, dg.act(F.col("t"), F.lit(anchored)), text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("um hello, can you tell me the parking fee for the", "the parking fee"),
        ("and um what are the rules without a permit", "what are the rules without a permit"),
        ("okay so", ""),
        ("dogs are not", "dogs are not"),
    ],
)
def test_built_query(spark, text, want):
    assert one(spark, dg.build_query(F.col("t")), text) == want


def test_clauses_and_roles(spark):
    text = "What is the fee and how do I pay? For students only. I meant seniors. It rained."
    parts = one(spark, dg.clauses(F.col("t")), text)
    assert parts == ["What is the fee", "how do I pay?", "For students only.", "I meant seniors.", "It rained."]
    roles = [one(spark, dg.clause_role(F.col("t")), p) for p in parts]
    assert roles == ["request", "request", "constraint", "correction", "narrative"]


def test_longest_phrase_wins(spark):
    assert one(spark, dg.phrase_hits(F.col("t"), ["tell me", "can you tell me"]), "Can you tell me or tell me") == ["can you tell me", "tell me"]


def gate(spark, **values):
    base = dict(act="INFO_REQUEST", n_terms=3, n_anchors=1, strength=0.9, stability=0.9, worth=0.8, dangling=False, final=False)
    frame = spark.createDataFrame([tuple({**base, **values}.values())], list(base))
    return tuple(frame.select(*dg.gate(F.lit(1.0))).first())


@pytest.mark.parametrize(
    "values, want",
    [
        ({}, ("RETRIEVE", "worthy_request")),
        ({"act": "SOCIAL"}, ("SKIP", "suppressed_act")),
        ({"n_terms": 0}, ("WAIT", "no_content")),
        ({"n_terms": 0, "final": True}, ("SKIP", "empty_content")),
        ({"dangling": True}, ("WAIT", "trailing_function_word")),
        ({"n_anchors": 0}, ("WAIT", "low_specificity")),
        ({"n_terms": 1, "strength": 0.5}, ("WAIT", "low_specificity")),
        ({"stability": 0.5}, ("WAIT", "awaiting_stability")),
        ({"worth": 0.4}, ("WAIT", "not_yet_worthy")),
        ({"worth": 0.4, "final": True}, ("RETRIEVE", "worthy_request")),
        ({"worth": 0.4, "final": True, "act": "UNKNOWN"}, ("SKIP", "not_worthy")),
    ],
)
def test_gate(spark, values, want):
    assert gate(spark, **values) == want


def test_budget_reserve_cooldown_and_novelty(spark):
    rows = [(1, 1, i, at, final, terms, "RETRIEVE", "worthy_request") for i, (at, final, terms) in enumerate([
        (0, False, ["a", "b"]), (100, False, ["c", "d"]), (500, False, ["c", "d"]), (1000, False, ["c", "d"]),
        (1500, False, ["e", "f"]), (2000, False, ["g", "h"]), (2500, True, ["i", "j"]),
    ])]
    frame = spark.createDataFrame(rows, "session long, utterance long, tick int, at_ms long, final boolean, terms array<string>, decision string, reason string")
    got = [(r.decision, r.reason) for r in dg.spend_budget(frame).orderBy("tick").collect()]
    assert got == [
        ("RETRIEVE", "worthy_request"), ("WAIT", "cooldown"), ("RETRIEVE", "worthy_request"), ("SKIP", "redundant"),
        ("RETRIEVE", "worthy_request"), ("WAIT", "provisional_budget_exhausted"), ("RETRIEVE", "worthy_request"),
    ]


def test_intent_relations(spark):
    rows = [(1, 1, 0, ["fee", "permit"]), (1, 1, 1, ["fee", "permit"]), (1, 1, 2, ["fee", "permit", "student"]), (1, 1, 3, ["zoo"])]
    frame = spark.createDataFrame(rows, "session long, utterance long, ord int, terms array<string>")
    got = {(r.ord_a, r.ord_b): r.relation for r in dg.intent_relations(frame).collect()}
    assert got == {(0, 1): "duplicate", (0, 2): "refines_a", (1, 2): "refines_a"}


def test_constraint_scope(spark):
    intents = spark.createDataFrame([(1, 1, 0, ["fee"]), (1, 1, 1, ["route"]), (2, 1, 1, ["fee"])], "session long, utterance long, ord int, terms array<string>")
    constraints = spark.createDataFrame([(1, 1, 2, ["fee", "student"]), (1, 1, 3, ["sunday"]), (2, 1, 0, ["adult"]), (3, 1, 0, ["x"])], "session long, utterance long, ord int, terms array<string>")
    got = {(r.session, r.ord): (r.n_applies, r.reason, r.confidence) for r in dg.scope(constraints, intents).collect()}
    assert got == {
        (1, 2): (1, "shares_term_with_one_intent", 0.9),
        (1, 3): (2, "restriction_applies_to_request", 0.6),
        (2, 0): (1, "fronted_restriction", 1.0),
        (3, 0): (0, "no_intent", 1.0),
    }


def test_term_statistics_are_joined_once(spark, tables):
    """Before, the terms of the documents were first cut down to the said ones, which shuffled both once more."""
    from quarrymark.plans import dialogue_queries

    plan = dialogue_queries.turns(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("/terms") + plan.count("idf#") > 0


LONG = " ".join(f"w{i % 97} x{i}" for i in range(1000))


def conversations(spark, rows, tables=None):
    """Tables with other conversations."""

    class Other:
        conversations = spark.createDataFrame([(c, u, "user", x) for c, u, x in rows], "conv_id long, turn long, role string, text string")

        def __getattr__(self, name):
            return getattr(tables, name)

    return Other()


def test_ticks_grow_with_the_text(spark):
    """Before, every tick held all words so far: 126 times the text here."""
    from quarrymark.plans import dialogue_queries

    ticks = dialogue_queries.provisional_ticks(conversations(spark, [(1, 0, LONG)]))
    n, chars, said = ticks.agg(F.count(F.lit(1)), F.sum(F.length("text")), F.sum(F.size("terms"))).first()
    assert n == 250 and chars <= 2 * len(LONG) and said <= 2 * len(LONG.split()) * 2


def test_budget_is_one_stream(spark, tables):
    """Before, every utterance was a group for pandas, and the terms of all its ticks were sorted once more."""
    from quarrymark.plans import dialogue_queries

    plan = dialogue_queries.controller_ticks(tables)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") == 1


def whole_ticks(t):
    """The ticks by definition: all the words so far, again at every tick."""
    from quarrymark.functions import text as tx
    from quarrymark.operators import corpus

    pieces = F.transform(corpus.word_windows(F.col("text"), 8, 0), lambda w: w["text"])
    rows = t.conversations.where("text IS NOT NULL").select(F.col("conv_id").alias("session"), F.col("turn").alias("utterance"), "text", pieces.alias("pieces"))
    ticks = rows.select("*", F.posexplode("pieces").alias("tick", "piece")).withColumn("final", F.col("tick") == F.size("pieces") - 1)
    text = F.when(F.col("final"), F.col("text")).otherwise(F.array_join(F.slice("pieces", 1, F.col("tick") + 1), " "))
    return ticks.select("session", "utterance", "tick", (F.col("tick") * 250 + 250).alias("at_ms"), "final", text.alias("text")).withColumn("terms", tx.terms(F.col("text")))


@pytest.fixture(scope="module")
def odd(spark, tables):
    some = [r.text for r in tables.conversations.where("turn < 2").orderBy("conv_id", "turn").limit(16).collect()]
    words = some[1].split()
    mixed = [
        "", "  ", "?!", "one", "a b c d e f tell me more please about 3.5 and 1,000 or 2,50 things " + " ".join(words[:30]),
        "x y z w v i would like to find out " + " ".join(words[:20]), "x y i would like to find out " + " ".join(words[:20]),
        "um uh yes ok um um uh uh yes yes ok ok " + " ".join(words[:12]), "hello hi hey " + " ".join(words[10:40]), "repeat rephrase that again please " * 6,
        "na\u00efve \u00e9 \u00e9i want to know i \u00e9want to know " + " ".join(words[:20]), "\u043c\u0438\u0440 for the \u043c\u0438\u0440 \u043c\u0438\u0440 " * 6 + "ok",
        "under_score foo_bar 12_3 4,5 6.7 don't it\u2019s \u201cquoted\u201d " * 5, "\u0130 want to know \u03a3\u0391\u03a3 " + " ".join(words[:30]),
        "which documents did i ask which sources what did i say " + " ".join(words[:3]), "the of and to " * 20, " ".join(words * 10), LONG[:2000],
    ]
    rows = [(i, 0, x) for i, x in enumerate(some + mixed)]
    rows += rows[:6] + [(None, 0, some[2]), (900, None, some[3]), (901, 0, None)]  # repeated rows, no key, no text
    rows += [(902, 0, " ".join(words[:20])), (902, 0, " ".join(words[5:45])), (902, 0, "tell me more")]  # several texts of one key
    return conversations(spark, rows, tables)


def test_growing_ticks_equal_whole_prefixes(spark, odd):
    """Signals at every tick are those of all its words; a null text gives no ticks, where it was an error before."""
    from quarrymark.plans import dialogue_queries as dq

    keys, shown = ["session", "utterance", "tick"], ["final", "act", "n_terms", "n_anchors", "max_idf", "dangling", "strength", "stability", "worth"]

    def judged(rows, *it):
        return dg.signals(rows.withColumn("persistence", F.when(F.col("final"), 1.0).otherwise(0.5)), dq.anchor_norm(odd), *it)

    whole = dq.term_signals(whole_ticks(odd), odd, keys)
    want = judged(whole.withColumn("act", dg.act(F.col("text"), F.col("n_anchors") > 0))).select(*keys, *shown).collect()
    ticks = dg.so_far(dq.provisional_ticks(odd), ["session", "utterance", "copy"])
    grown = dq.term_signals(ticks, odd, ["session", "utterance", "copy", "tick"], grows=True)
    got = judged(grown.withColumn("act", dg.act(dg.said(), F.col("n_anchors") > 0)), dg.said()).select(*keys, *shown).collect()
    assert len(want) > 300 and len({r.act for r in want}) >= 4
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_growing_budget_equals_whole_sets(spark, odd):
    from quarrymark.plans import dialogue_queries as dq

    def spent(ticks, **how):
        frame = ticks.withColumn("decision", F.when(F.col("tick") % 3 < 2, "RETRIEVE").otherwise("WAIT")).withColumn("reason", F.lit("x"))
        return sorted(map(str, dg.spend_budget(frame, **how).collect()))

    one_text = "utterance IS NOT NULL AND session IS NOT NULL AND session <> 902"  # the order of several texts was left open
    want = spent(whole_ticks(odd).where(one_text))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # an utterance goes over many batches
        assert spent(dq.provisional_ticks(odd).where(one_text), grows=True) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len({r for r in want}) > 100 and any("redundant" in r for r in want) and any("budget" in r for r in want)


def test_no_phrase_reaches_over_two_pieces():
    assert dg.LOOKBACK <= 8
