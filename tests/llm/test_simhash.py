from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from corpus_cases import from_folder, prose

from quarrymark.llm import pigeonring, simhash
from quarrymark.llm.components import components


def print_of(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int]) -> list[int]:
    """Index of the first member of each one's component, by comparing all pairs."""
    values, parent = np.array(prints, dtype=np.uint64), list(range(len(prints)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4) + i + 1:
            a, b = sorted((top(i), top(int(j))))
            parent[b] = a
    return [top(i) for i in range(len(prints))]


def same(docs) -> None:
    rows = docs.collect()
    prints = [print_of(r["text"]) for r in rows]
    tops = groups(prints)
    ids = defaultdict(list)
    for t, r in zip(tops, rows, strict=True):
        ids[t].append(r["doc_id"])
    least = {t: min((i for i in v if i is not None), default=None) for t, v in ids.items()}
    want = Counter((r["doc_id"], f"{p:016x}", least[t]) for r, p, t in zip(rows, prints, tops, strict=True))
    assert Counter(tuple(r) for r in simhash.digests(docs).collect()) == want


def test_documents(spark):
    same(from_folder(spark, "documents"))


def test_awkward(awkward, nothing):
    same(awkward)
    assert simhash.digests(nothing).count() == 0 and simhash.deduplicated(nothing).count() == 0


def test_one_document_of_each_group_stays(spark, awkward):
    kept = simhash.deduplicated(awkward)
    assert kept.columns == awkward.columns
    got = kept.collect()
    assert len(got) == simhash.digests(awkward).select("component_id").distinct().count()
    docs = from_folder(spark, "documents")
    ids = [r["doc_id"] for r in simhash.deduplicated(docs).collect()]
    assert Counter(ids) == Counter({r["component_id"]: 1 for r in simhash.digests(docs).collect()})


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def clusters(seed: int, centres: int, members: int, flips: int) -> list[int]:
    rng = np.random.default_rng(seed)
    out = set()
    for centre in rng.integers(0, 2**64, centres, dtype=np.uint64):
        for _ in range(members):
            value = int(centre)
            for bit in rng.integers(0, 64, rng.integers(0, flips + 1)):
                value ^= 1 << int(bit)
            out.add(value)
    return sorted(out)


@pytest.mark.parametrize("work", [1 << 27, 100])
def test_links_connect_what_pairs_connect(spark, monkeypatch, work):
    monkeypatch.setattr(pigeonring, "FILE_WORK", work)
    points = clusters(1, 30, 40, 5) + clusters(2, 200, 1, 0)
    frame = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    # the workers read the module anew, so the bound is tried on the plain functions as well
    edges = pigeonring.links(frame)
    label = {r["node"]: r["label"] for r in components(edges).collect()}
    want = defaultdict(set)
    for p, t in zip(points, groups(points), strict=True):
        want[t].add(label.get(signed(p), signed(p)))
    assert all(len(v) == 1 for v in want.values()) and len(set().union(*want.values())) == len(want)


def test_points_link_like_pairs(spark):
    points = clusters(3, 6, 30, 4)
    frame = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    label = {r["node"]: r["label"] for r in components(pigeonring._through_points(frame)).collect()}
    want = defaultdict(set)
    for p, t in zip(points, groups(points), strict=True):
        want[t].add(label.get(signed(p), signed(p)))
    assert all(len(v) == 1 for v in want.values()) and len(set().union(*want.values())) == len(want)


def test_a_large_file_is_a_forest():
    points = np.array(clusters(5, 1, 3000, 2), dtype=np.uint64)
    edges = pigeonring.forest(points[: len(points) // 2], points[len(points) // 2 :])
    assert sum(len(a) for a, _ in edges) < len(points)
    for a, b in edges:
        assert (np.bitwise_count(a ^ b) <= 4).all()


def test_files_go_on_across_batches():
    import pyarrow as pa

    rows = [(7, False, 1), (7, False, 3), (7, True, 2), (8, True, 5), (9, False, 1 << 40), (9, True, 1 << 41)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[r], strict=True)], names=["b", "v", "f"]) for r in rows]
    found = [tuple(x.values()) for out in pigeonring._linked(iter(batches)) for x in out.to_pylist()]
    assert len(found) == 3 and not any(f[0] for f in found) and {frozenset(f[1:]) for f in found} >= {frozenset({1 << 40, 1 << 41})}


def test_file_limits_turn_to_points(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pigeonring, "FILE_ROWS", 3)
    rows = [(7, False, i) for i in range(6)] + [(8, False, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[r], strict=True)], names=["b", "v", "f"]) for r in rows]
    found = [tuple(x.values()) for out in pigeonring._linked(iter(batches)) for x in out.to_pylist()]
    assert {f[1] for f in found} == set(range(6)) and all(f[0] for f in found)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (900, 900)], "a long, b long")
    label = {r["node"]: r["label"] for r in components(edges).collect()}
    assert {label[i] for i in range(201)} == {label[0]} and label[500] == label[501] != label[0] and 900 not in label


def test_shingles_and_short_texts():
    for text in ("", " \n", "One", "one two three", "a b c d", prose(200), "É\x0bx  Y", "a\x00b c", "\x1cx y"):
        assert simhash.fingerprint(text.encode()) & (2**64 - 1) == print_of(text)
