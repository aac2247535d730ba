from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from corpus_cases import from_folder

from quarrymark.llm import pruned_graph, vector_graph

VECTORS = "vec_id long, embedding array<float>, label int, shard string, score string"


def exact(rows: list[tuple], k: int = 5) -> dict[int, list[tuple]]:
    """All cosines in double precision: {query: [(vec_id, score)]}."""
    usable = {}
    for vec_id, vector in rows:
        if vec_id is not None and vector is not None and None not in vector and np.isfinite(vector).all() and np.any(vector):
            usable.setdefault(vec_id, set()).add(tuple(vector))
    found = {}
    for query in (q for q in usable if q % 50 == 0):
        best = {}
        for asked in usable[query]:
            for other, vectors in usable.items():
                for v in vectors if other != query else ():
                    if len(v) == len(asked):
                        a, b = np.array(asked, dtype=np.float64), np.array(v, dtype=np.float64)
                        cos = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
                        best[other] = max(best.get(other, -2), cos)
        if best:
            found[query] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return found


def answers(df) -> dict[int, list[tuple]]:
    found = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(found)


def test_recall_and_exact_scores(spark):
    table = from_folder(spark, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want, got = exact(rows), answers(vector_graph.digests(table))
    assert want.keys() == got.keys() and all(len(got[q]) == len(want[q]) for q in want)
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, found in got.items():
        for v, score in found:
            a, b = vectors[q], vectors[v]
            assert score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-14)


def test_awkward(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 1.0], None), (4, None, 1),
        (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (None, [1.0, 0.0], 1), (50, [1.0, 1.0], 1),
        (100, [1.0, 0.0, 0.0], 1), (101, [0.5, 0.5, 0.0], 1), (150, [1.0, 2.0, 3.0, 4.0], 1), (200, [], 1), (9, [3e38, 3e38], 1),
        (10, [1e-40, 1e-40], 1), (11, [-1.0, 0.0], 1), (-50, [0.0, -1.0], 1), (3, [1.0, 0.5], 1),
    ]
    table = spark.createDataFrame([(*r, "s", "t") for r in rows], VECTORS)
    floats = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want, got = exact(floats), answers(vector_graph.digests(table))
    assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}
    assert all(s == pytest.approx(t, abs=1e-12) for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


def test_empty(spark):
    nothing = spark.createDataFrame([], VECTORS)
    assert vector_graph.digests(nothing).count() == 0
    assert vector_graph.digests(nothing).columns == ["query_id", "rank", "vec_id", "score"]


def test_many_copies_of_one_vector(spark):
    draw = np.random.default_rng(1)
    common = draw.normal(size=16).astype(np.float32).tolist()
    rows = [(i, common if i % 3 == 0 else draw.normal(size=16).astype(np.float32).tolist(), 0, "", "") for i in range(1200)]
    got = answers(vector_graph.digests(spark.createDataFrame(rows, VECTORS)))
    assert [v for v, _ in got[0]] == [3, 6, 9, 12, 15] and [v for v, _ in got[300]] == [0, 3, 6, 9, 12]
    index = vector_graph.build(spark.createDataFrame(rows, VECTORS))
    assert index.count() == 801 and max(len(r["ids"]) for r in index.select("ids").collect()) == 6


def test_several_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "LEAST_ROWS", 100)
    monkeypatch.setattr(vector_graph, "PART", 3)
    table = from_folder(spark, "embeddings")
    want = exact([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = answers(vector_graph.digests(table))
    assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}
    assert vector_graph.build(table).select("shard").distinct().count() == 5


def test_shards_follow_the_data():
    count = [vector_graph.shards_for(n, n * 256) for n in (0, 1, 8192, 8193, 10**6, 10**8)]
    assert count == [1, 1, 1, 2, 64, 382]


def test_edges_are_few_and_diverse():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = pruned_graph.built(x)
    assert (graph.edges >= 0).any(axis=1).all() and graph.edges.shape[1] == pruned_graph.DEGREE
    assert all(len(set(e[e >= 0])) == (e >= 0).sum() and i not in e for i, e in enumerate(graph.edges))
    found = graph.search(x[:300], 128)
    real = np.argsort(-(x[:300] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b[:6])) / 6 for a, b in zip(real, found, strict=True)]) > 0.97


def test_robust_pruning_by_hand():
    angles = np.deg2rad([0, 10, 14, -40, 90])
    x = np.stack((np.cos(angles), np.sin(angles)), axis=1).astype(np.float32)
    near = (x[1:] @ x[0])[None, :]
    # 14 degrees is reached over 10 degrees, -40 is not; 90 is
    assert pruned_graph.pruned(x, near, np.array([[1, 2, 3, 4]]), 3, 1.2).tolist() == [[1, 3, -1]]
