from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from corpus_cases import from_folder

from quarrymark.llm import mixing


def checked(rows, targets: dict, block=mixing.BLOCK) -> None:
    """Windows of the given targets, one block a slot, and a deviation of less than one block after every slot."""
    at: dict[int, tuple] = {}
    size = Counter()
    blocks = defaultdict(set)
    for r in rows:
        blocks[r["source"]].add(r["block"])
        if r["target_weight"] is not None:
            assert r["target_weight"] == pytest.approx(targets[r["source"]], rel=1e-9)
        if r["slot"] is None:
            continue
        assert r["release"] <= r["slot"] < r["deadline"]
        assert at.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
        size[r["slot"]] += 1
    assert max(size.values(), default=0) <= block
    done = Counter()
    for t in range(max(at, default=-1) + 1):
        if t in at:
            source, number = at[t]
            assert number == done[source]
            done[source] += 1
        for source, w in targets.items():
            if done[source] < len(blocks[source]):
                assert abs(done[source] - (t + 1) * w) < 1


def derived(sizes: Counter, flatten: float = mixing.FLATTEN) -> dict:
    step = math.log(mixing.STEP)
    raw = {s: mixing.STEP ** math.floor(math.log(n) * flatten / step + 0.5) for s, n in sizes.items()}
    return {s: w / sum(raw.values()) for s, w in raw.items()}


def test_documents(spark):
    docs = from_folder(spark, "documents", "/root/testdata/sf0.01")
    rows = mixing.mixed(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    kept = [r["position"] for r in rows if r["in_mix"]]
    assert len(set(kept)) == len(kept)
    checked(rows, derived(Counter(r["source"] for r in rows)))


def test_hot_source_is_trimmed_and_others_are_whole(spark):
    sources = ["hot"] * 3000 + [f"s{i}" for i in range(9) for _ in range(400)]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "doc_id long, source string")
    rows = mixing.mixed(docs, flatten=0.5).collect()
    checked(rows, derived(Counter(sources), 0.5))
    taken, all_rows = Counter(r["source"] for r in rows if r["in_mix"]), Counter(sources)
    assert all(taken[s] == n for s, n in all_rows.items() if s != "hot") and 0 < taken["hot"] < 3000
    assert abs(taken["hot"] / sum(taken.values()) - next(r["target_weight"] for r in rows if r["source"] == "hot")) < 0.02


def test_given_weights(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(600)], "doc_id long, source string")
    rows = mixing.mixed(docs, {"a": 5, "b": 3, "unknown": 2}, block=4).collect()
    checked(rows, {"a": 5 / 8, "b": 3 / 8}, 4)
    assert {r["target_weight"] for r in rows if r["source"] == "c"} == {None}
    assert not any(r["in_mix"] for r in rows if r["source"] == "c")


def test_awkward(awkward):
    rows = mixing.mixed(awkward).collect()
    checked(rows, derived(Counter(r["source"] for r in rows)))
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in awkward.collect())
    assert mixing.taken(awkward).columns == awkward.columns


def test_empty(nothing):
    assert mixing.mixed(nothing).count() == 0 and mixing.taken(nothing).count() == 0


def test_schedule_is_earliest_deadline_first(spark):
    rows = [(1, 0.5, 1, 9, True), (2, 0.1, 3, 2, True), (3, 0.2, 1, 4, True)]
    groups = spark.createDataFrame(rows, "grp int, w double, members long, blocks long, favoured boolean")
    got = {r["slot"]: (r["grp"], r["turn"]) for r in mixing.schedule(groups, 40).collect()}
    done = Counter()
    for t in range(40):
        ready = []
        for g, w, members, blocks, _ in rows:
            j = done[g] // members
            if j < blocks and math.floor(j / w + 1e-9) <= t:
                ready.append((math.ceil((j + 1) / w - 1e-9), g))
        pick = min(ready)[1] if ready else None
        assert got.get(t) == (None if pick is None else (pick, done[pick]))
        done[pick] += pick is not None


@pytest.mark.parametrize("target", [{"a": 1 / 2, "b": 1 / 3, "c": 1 / 6}, {"a": 1 / 3, "b": 0.123457, "c": 1 - 1 / 3 - 0.123457}])
def test_no_drift_over_a_hundred_thousand_slots(spark, target):
    docs = spark.range(100_000).selectExpr("id AS doc_id", "element_at(array('a', 'b', 'c'), CAST(id % 3 + 1 AS INT)) AS source")
    weights = {s: int(w * 90_000) for s, w in target.items()}
    some = docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] + 10**6)).unionByName(docs.withColumn("doc_id", docs["doc_id"] + 10**7))
    rows = mixing.mixed(some, target, block=1).collect()
    checked(rows, target, 1)
    taken = Counter(r["source"] for r in rows if r["in_mix"])
    assert all(taken[s] > n for s, n in weights.items())


def test_seventy_sources_one_of_them_hot(spark):
    sizes = Counter({"hot": 14_000} | {f"s{i}": 100 + 13 * i for i in range(70)})
    docs = spark.createDataFrame(list(enumerate(sizes.elements())), "doc_id long, source string")
    rows = mixing.mixed(docs, block=1).collect()
    checked(rows, derived(sizes), 1)
    taken = Counter(r["source"] for r in rows if r["in_mix"])
    assert all(taken[s] == n for s, n in sizes.items() if s != "hot")


def test_two_thousand_sources_and_one_hot(spark):
    sizes = Counter({"hot": 10_000} | {f"s{i}": 10 for i in range(2000)})
    docs = spark.createDataFrame(list(enumerate(sizes.elements())), "doc_id long, source string")
    target = {"hot": 0.33} | {f"s{i}": 0.67 / 2000 for i in range(2000)}
    for given in (target, None):
        rows = mixing.mixed(docs, given).collect()
        assert len(rows) == sizes.total()
        checked(rows, given or derived(sizes))
        taken = Counter(r["source"] for r in rows if r["in_mix"])
        assert all(taken[s] == 10 for s in sizes if s != "hot") and taken["hot"] > 2000


def test_single_documents_beside_large_sources(spark):
    sizes = Counter({f"big{i}": 6000 + 500 * i for i in range(3)} | {f"s{i}": 1 + i % 4 for i in range(8)})
    docs = spark.createDataFrame(list(enumerate(sizes.elements())), "doc_id long, source string")
    rows = mixing.mixed(docs, block=1).collect()
    checked(rows, derived(sizes), 1)
    kept = [r["position"] for r in rows if r["in_mix"]]
    assert len(set(kept)) == len(kept)


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    sizes = Counter({"a": 6000, "b": 3000, "c": 500})
    docs = spark.createDataFrame(list(enumerate(sizes.elements())), "doc_id long, source string")
    rows = mixing.mixed(docs).collect()
    checked(rows, derived(sizes), 190)
    assert max(r["block"] for r in rows) == 31
