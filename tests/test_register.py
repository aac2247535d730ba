"""The claim register: batches against all observations at once, and the rules of revalidation one by one."""

from __future__ import annotations

import random
from collections import Counter

from quarrymark.operators import register

OBSERVED = "lineage string, evidence string, start long, end long, at long, relevance double"


def rows(df) -> Counter:
    return Counter(tuple(r) for r in df.select(*register.KEY, "version", "at", "until", "created", "relevance").collect())


def test_batches_equal_all_observations(spark):
    draw = random.Random(8)
    seen = [
        (f"l{draw.randrange(3)}", f"e{draw.randrange(4)}", s := draw.randrange(3), s + 5, at, draw.randrange(10) / 10)
        for at in range(6)
        for _ in range(30)
    ]
    frame = spark.createDataFrame(seen, OBSERVED)
    found = register.history(frame.where("at < 2"))
    for low, high in ((2, 3), (3, 5), (5, 6)):
        found = register.merged(found, frame.where(f"at >= {low} AND at < {high}"))
    assert rows(found) == rows(register.history(frame))
    open_ = Counter(tuple(r) for r in register.current(found).select(*register.KEY).collect())
    assert set(open_.values()) == {1} and len(open_) == len({s[:4] for s in seen})


def test_late_observations_change_nothing(spark):
    first = spark.createDataFrame([("l", "e", 0, 5, 10, 0.5)], OBSERVED)
    late = spark.createDataFrame([("l", "e", 0, 5, 9, 0.9), ("l", "e", 0, 5, 10, 0.9), ("l", "e", 0, 5, 12, 0.7)], OBSERVED)
    found = register.merged(register.history(first), late)
    assert rows(found) == Counter({("l", "e", 0, 5, 1, 10, 12, 10, 0.5): 1, ("l", "e", 0, 5, 2, 12, None, 10, 0.7): 1})


def test_a_merge_into_nothing_and_of_nothing(spark):
    empty = spark.createDataFrame([], OBSERVED)
    some = spark.createDataFrame([("l", "e", 0, 5, 1, 0.5), ("l", "e", 0, 5, 1, 0.8)], OBSERVED)
    want = Counter({("l", "e", 0, 5, 1, 1, None, 1, 0.8): 1})
    assert rows(register.merged(register.history(empty), some)) == want == rows(register.merged(register.history(some), empty))


def test_rules_of_revalidation(spark):
    claims = [(f"l{i}", f"e{i}", 0, 5, 1, 3, ["fee", "2024"]) for i in range(9)]
    frame = spark.createDataFrame(claims, "lineage string, evidence string, start long, end long, version long, at long, terms array<string>")
    states = ["ACTIVE", "ACTIVE", "SUPERSEDED", "REMOVED", "ACTIVE", "ACTIVE", "ACTIVE", "ACTIVE"]
    lineages = [(f"l{i}", s, 4 if i == 4 else 3) for i, s in enumerate(states)]
    evidence = [("e0", "VALID"), ("e1", "PARTIAL"), ("e2", "VALID"), ("e3", "VALID"), ("e4", "VALID"), ("e5", "REVALIDATION_REQUIRED"), ("e6", "REMOVED"), ("e8", "VALID")]
    asked = [("l1", "k2", ["age"]), ("l1", "k1", ["fee", "under"]), ("l0", "k3", ["fee"]), ("l6", "k4", ["age"])]
    got = register.revalidated(
        frame,
        spark.createDataFrame(lineages, "lineage string, state string, latest long"),
        spark.createDataFrame(evidence, "evidence string, evidence_state string"),
        spark.createDataFrame(asked, "lineage string, constraint string, terms array<string>"),
    )
    assert {r["lineage"]: (r["status"], r["reason"]) for r in got.collect()} == {
        "l0": ("SUPPORTED", "verbatim_in_valid_evidence"),
        "l1": ("PARTIALLY_SUPPORTED", "does_not_address_constraint:k1,k2"),
        "l2": ("SUPERSEDED", "intent_superseded"),
        "l3": ("STALE", "intent_removed"),
        "l4": ("STALE", "not_selected_for_version"),
        "l5": ("PENDING_VALIDATION", "awaiting_evidence_revalidation"),
        "l6": ("UNSUPPORTED", "evidence_removed"),
        "l7": ("UNSUPPORTED", "evidence_missing"),
        "l8": ("SUPERSEDED", "intent_superseded"),
    }
