"""Hot keys, exactness against brute force, and the shape of the plans."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymark.operators import dense, metrics, state
from quarrymark.operators.joins import attach
from quarrymark.operators.ordered import Split, islands
from quarrymark.plans.catalogue import CATALOGUE


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 300), i, rng.randint(0, 9)) for i in range(6000)]
    return spark.createDataFrame(rows, "k int, i int, v int")


def test_attach_equals_join(skewed):
    per = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    got, want = attach(skewed, per, ["k"]).select("k", "i", "v", "n", "m"), skewed.join(per, "k").select("k", "i", "v", "n", "m")
    assert got.exceptAll(want).count() == 0 and got.count() == 6000


def test_split_windows_equal_plain_windows(skewed):
    split = Split(["k"], ["i"], F.floor(F.col("i") / 250))
    w = Window.partitionBy("k").orderBy("i")
    want = skewed.select("k", "i", "v", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.sum("v").over(w).alias("s"))
    got = split.running_sum(split.lead(split.lag(skewed, p="v"), n="v"), "s", F.col("v"))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_islands(spark):
    rows = [(1, o, v) for o, v in enumerate([1, 2, 3, 7, 8, 1])]
    got = islands(spark.createDataFrame(rows, "k int, o int, v int"), Split(["k"], ["o"], F.floor(F.col("o") / 2)), "v")
    assert [r.island for r in got.orderBy("o").collect()] == [1, 1, 1, 2, 2, 3]


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(1, 120)] + [(2000 + i, 2001 + i) for i in range(40)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.group for r in state.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_containment_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(80)]
    asked = []
    for q in range(30):
        text = rng.choice(docs)[1]
        a = rng.randint(0, len(text) - 2)
        asked.append((q, text[a : a + rng.randint(2, 45)].strip() or "w1"))
    got = metrics.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string"))
    assert {(r.qid, r.doc_id) for r in got.collect()} == {(q, d) for q, p in asked for d, t in docs if p in t}


def test_dense_search_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base, ask = rng.normal(size=(300, 8)), rng.normal(size=(25, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(ask)], "qid long, embedding array<double>")
    monkeypatch.setattr(dense, "BLOCK", 4)
    got = {}
    for r in dense.search(vectors, queries, k=5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vec_id)
    scores = np.round(ask @ base.T, 6)
    assert got == {q: list(np.lexsort((np.arange(300), -scores[q]))[:5]) for q in range(25)}
    near = {r.vec_id: r.qid for r in dense.nearest(vectors, queries, n=1).collect()}
    assert near == {v: int(np.argmax(scores[:, v])) for v in range(300)}
    wrong = spark.createDataFrame([(1, [1.0, 2.0])], "qid long, embedding array<double>")
    with pytest.raises(Exception, match="dimensions"):
        dense.search(vectors, wrong, k=1).collect()


def test_filters_and_columns_reach_the_scan(tables):
    text = plan(CATALOGUE["bm25_filtered_topk"].build(tables))
    assert "EqualTo(lang,en)" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(CATALOGUE["document_ids"].build(tables))


def test_top_k_limits_groups_before_the_exchange(tables):
    for name in ("bm25_topk", "per_source_cap"):
        assert "WindowGroupLimit" in plan(CATALOGUE[name].build(tables))


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_no_cartesian_plans(tables, name):
    text = plan(CATALOGUE[name].build(tables))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_ranking_reads_the_index_and_no_text(tables):
    for name in ("doc_freq", "bm25_topk", "bm25_filtered_topk", "bm25_rare_terms", "fusion_rrf"):
        tree = plan(CATALOGUE[name].build(tables))
        scans = [part for part in tree.split("\n\n") if "Scan parquet" in part and "ReadSchema" in part]
        assert any("cf:bigint" in s or "entries:array" in s for s in scans), name
        texts = [s for s in scans if "documents.parquet" in s and "text:" in s]
        assert not texts, name


def test_claims_are_verified_from_sentences_cut_once(tables):
    for name in ("verify_claims", "stop_reason", "harness_report", "dedup_near_pairs"):
        tree = plan(CATALOGUE[name].build(tables))
        scans = [part for part in tree.split("\n\n") if "Scan parquet" in part and "ReadSchema" in part]
        assert len([s for s in scans if "documents.parquet" in s]) <= 1, name


def test_spread_follows_the_size_of_the_plan(tables, monkeypatch):
    from quarrymark.sources import tables as source

    docs = tables.documents.select("doc_id", "text")
    assert "Exchange" in plan(source.spread(docs, "doc_id"))
    monkeypatch.setattr(source, "SPREAD_BYTES", 100)
    assert source.spread(docs, "doc_id") is docs


def zipf_corpus(spark, n: int):
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.choice([3, 20, 60, 200])))) for i in range(n)]
    return spark.createDataFrame([*texts, (n, ""), (n + 1, None)], "doc_id long, text string")


@pytest.mark.parametrize(("docs_a_range", "seeds", "k"), [(8, 1, 3), (32, 3, 10), (128, 3, 2000)])
def test_skipped_blocks_change_nothing(spark, tmp_path, monkeypatch, docs_a_range, seeds, k):
    from quarrymark.operators import lexical
    from quarrymark.sources import index

    monkeypatch.setattr(index, "RANGE_DOCS", docs_a_range)
    monkeypatch.setattr(index, "SEED_RANGES", seeds)
    docs = zipf_corpus(spark, 1500)
    found = index.LexicalIndex(spark, index.build(docs, str(tmp_path)))
    rng = random.Random(5)
    asked = [(q, " ".join(f"w{rng.randint(1, 60)}" for _ in range(rng.randint(1, 6)))) for q in range(25)] + [(99, "unknown"), (100, "")]
    queries = spark.createDataFrame(asked, "qid long, query string")
    want = lexical.bm25_top(lexical.Texts(docs), queries, k=k)
    got = found.search(queries, k=k)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(got.columns).collect()}
    some = docs.where("doc_id % 3 = 0")
    kept = found.search(queries, k=k, only=some)
    every = lexical.bm25_scores(lexical.Texts(docs), queries).join(some, "doc_id", "left_semi")
    scores = {(r.qid, r.doc_id): r.score for r in every.collect()}
    assert all(scores[r.qid, r.doc_id] == r.score for r in kept.collect())
    assert kept.count() == sum(min(k, sum(q == i for q, _ in scores)) for i, _ in asked)
    if docs_a_range == 8:  # most blocks are never opened
        terms = lexical.query_terms(queries).join(found.terms.select("term", "idf"), "term")
        bounds = found.bounds(terms)
        least = got.where(f"rank = {k}").select("qid", "score")
        reach = bounds.join(least, "qid").where("bound >= score")
        assert reach.count() < 0.5 * bounds.join(least, "qid").count()


def test_bounds_hold_for_every_document(spark, tmp_path):
    from quarrymark.operators import lexical
    from quarrymark.sources import index

    docs = zipf_corpus(spark, 400)
    found = index.LexicalIndex(spark, index.build(docs, str(tmp_path)))
    queries = spark.createDataFrame([(q, f"w{q} w{q + 1} w{2 * q}") for q in range(1, 20)], "qid long, query string")
    terms = lexical.query_terms(queries).join(found.terms.select("term", "idf"), "term")
    placed = lexical.bm25_scores(found, queries).join(found.documents, "doc_id").join(found.bounds(terms), ["qid", "range"])
    assert placed.count() > 100 and placed.where("score > bound + 1e-6").count() == 0


def test_no_driver_collect_in_operators():
    import pathlib

    folder = pathlib.Path(__file__).resolve().parents[1] / "quarrymark" / "operators"
    assert not [p.name for p in folder.glob("*.py") if ".collect()" in p.read_text() or ".toPandas()" in p.read_text()]


def test_roots_of_a_long_chain_and_of_a_circle(spark):
    from quarrymark.operators import events

    rows = [(i, i - 1 if i else None) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (103, 100)]
    got = {r.k: (r.root, r.hops) for r in events.roots(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()}
    assert all(got[i] == (0, i) for i in range(50))
    assert all(got[i] == (None, None) for i in (100, 101, 102, 103))


@pytest.mark.parametrize("least", [0.0, 0.5, 0.8])
def test_similarity_looks_at_every_earlier_query(spark, least):
    rng = random.Random(8)
    rows = [(1, i, sorted({rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 6))})) for i in range(200)]
    rows += [(2, 0, ["x", "y", "z", "u", "v"]), *[(2, i, [f"t{i}"]) for i in range(1, 40)], (2, 40, ["x", "y", "z", "u", "v"])]
    frame = spark.createDataFrame(rows, "k long, at long, terms array<string>")
    got = {(r.k, r.at): (r.similarity, r.most_similar) for r in state.recent_similarity(frame, "k", "at", least=least).collect()}
    for k, at, terms in rows:
        mine, best = set(terms), (0.0, None)
        for k2, other, theirs in rows:
            if k2 == k and other < at:
                union = mine | set(theirs)
                s = len(mine & set(theirs)) / len(union) if union else 1.0
                if s >= least and s > best[0]:
                    best = (s, other)
        assert got[k, at][0] == round(best[0], 6) and got[k, at][1] == best[1]
    assert got[2, 40] == (1.0, 0)


@pytest.mark.parametrize("least", [0.0, 0.75])
def test_no_sets_travel_with_the_terms_of_queries(spark, tables, least):
    """Before, every term of a query carried the whole query, into a broadcast whose size the plan took for that of the table."""
    from quarrymark.plans.state_queries import session_queries

    rows = state.recent_similarity(session_queries(tables), "conv_id", "turn", least=least)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    travels = re.findall(r"Generate explode\(.*\), \[([^\]]*)\], false, \[_term", plan)
    assert len(travels) == 2 and not any("_set" in columns for columns in travels)
    assert not re.search(r"BroadcastHashJoin \[[^\]]*_(?:term|id)#", plan)
    twice = [(1, 1, ["a", "b"]), (1, 1, ["a", "b"]), (1, 1, ["c"]), (1, 2, ["a", "b"])]  # repeated places count once
    got = state.recent_similarity(spark.createDataFrame(twice, "k long, at long, terms array<string>"), "k", "at", least=least)
    assert sorted((r.at, r.similarity, r.most_similar) for r in got.collect()) == [(1, 0.0, None)] * 3 + [(2, 1.0, 1)]


def test_optimal_matching_equals_all_permutations():
    from itertools import permutations

    from quarrymark.operators.matching import assignment

    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (2, 4), (4, 2), (5, 5), (3, 6)):
        for _ in range(20):
            gain = np.round(rng.random((n, m)), 2)
            got = sum(gain[i, j] for i, j in assignment(gain))
            g = gain if n <= m else gain.T
            assert got == pytest.approx(max(sum(g[i, p[i]] for i in range(len(g))) for p in permutations(range(g.shape[1]), len(g))))


def test_short_units_and_words_are_facts(spark):
    from quarrymark.functions import values as vx

    rows = spark.createDataFrame([("mm",), ("Millimetres",), ("s",), ("metre",), ("hours",), ("kg",)], ["u"])
    assert [r[0] for r in rows.select(vx.unit_sign(F.col("u"))).collect()] == ["mm", "mm", "s", "m", "h", "kg"]
