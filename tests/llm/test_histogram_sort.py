from __future__ import annotations

import random
import zlib
from collections import defaultdict

from corpus_cases import from_folder

from quarrymark.llm import histogram_sort as hs


def held(docs, rows, shards=8, tolerance=0.001, row_limit=None) -> None:
    """Sizes and checksums are right, slots are gapless, bytes are even up to one row."""
    texts = defaultdict(list)
    for d in docs.collect():
        texts[d["doc_id"]].append((d["text"] or "").encode())
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        texts[r["doc_id"]].remove(next(b for b in texts[r["doc_id"]] if len(b) + 1 == r["size"] and zlib.crc32(b) == r["text_crc32"]))
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert not any(texts.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total, largest = sum(sizes.values()), max(r["size"] for r in rows)
    assert all(abs(v - total / shards) <= 2 * tolerance * total / shards + (row_limit or 2 * largest) for v in sizes.values())


def test_documents(spark):
    docs = from_folder(spark, "documents", "/root/testdata/sf0.01")
    held(docs, hs.manifest(docs).collect())


def test_awkward(awkward):
    rows = hs.manifest(awkward).collect()
    held(awkward, rows)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_empty(nothing):
    assert hs.manifest(nothing).count() == 0


def test_one_text_holds_a_third_of_the_rows(spark):
    rng = random.Random(4)
    rows = [(i, "hot text " * 4 if i % 3 == 0 else f"text {rng.random()} " * rng.randint(1, 5)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held(docs, hs.manifest(docs).collect(), row_limit=400)


def test_identical_rows_are_parted(spark):
    docs = spark.createDataFrame([(1, "abc")] * 800, "doc_id long, text string")
    rows = hs.manifest(docs).collect()
    held(docs, rows)
    assert {r["shard"] for r in rows} == set(range(8))


def test_equal_texts_lie_together(spark):
    rows = [(i, f"text number {i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = defaultdict(set)
    for r in hs.manifest(docs).collect():
        shards[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 7


def test_splitters_are_exact_counts(spark):
    rows = hs.keyed(from_folder(spark, "documents", "/root/testdata/sf0.01")).cache()
    bounds = hs.splitters(rows, 8, 0.001)
    assert bounds == sorted(bounds) and len(bounds) == 7
    sizes = [(r["k_text"], r["k_id"], r["k_row"], r["size"]) for r in rows.collect()]
    total = sum(s[3] for s in sizes)
    for i, b in enumerate(bounds, 1):
        below = sum(s[3] for s in sizes if s[:3] < b)
        nearest = min(abs(sum(s[3] for s in sizes if s[:3] < x[:3]) - total * i / 8) for x in sizes)
        assert abs(below - total * i / 8) <= max(0.001 * total / 8, nearest) + 40000
    rows.unpersist()
