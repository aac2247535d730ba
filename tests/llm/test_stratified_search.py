from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from corpus_cases import from_folder
from pyspark.sql import functions as F

from quarrymark.llm import stratified_search as lexical
from quarrymark.llm import stratum_index
from quarrymark.llm.word_hashes import raw, slices, words_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id string, text string, score string"


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOW))


def by_hand(docs: list[tuple], items: list[tuple], k: int = 20) -> Counter:
    counted = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    counted = [c for c in counted if c[2]]
    n_docs, total = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for doc, c, n in counted:
            m = 75 + (25 * n * n_docs) // total
            s = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scored.append((-s, doc is None, doc))
        for rank, (s, _, doc) in enumerate(sorted(scored)[:k], 1):
            out[(item, rank, doc, -s)] += 1
    return out


def same(docs, items, k: int = 20) -> None:
    got = Counter(tuple(r) for r in lexical.search(lexical.build(docs), items, k).select("item_id", "rank", "doc_id", "score").collect())
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], k)
    assert got == want


def test_against_plain_code(spark):
    same(from_folder(spark, "documents"), from_folder(spark, "benchmark"))


def test_awkward(spark, awkward):
    items = spark.createDataFrame(
        [("a", "the QUICK brown fox the fox", "s"), ("a", "the QUICK brown fox the fox", "s"), (None, "Ünïcödé 日本語 a", None),
         ("b", None, "s"), ("c", "", "s"), ("d", "nothingknown", "s"), ("e", "x" * 50000 + " word line 13", "s")], ITEMS)
    same(awkward, items)
    same(awkward, items, k=2)


def test_empty(spark, nothing, awkward):
    items = spark.createDataFrame([("a", "fox", "s")], ITEMS)
    assert lexical.digests(nothing, items).count() == 0
    assert lexical.digests(awkward, items.where("false")).count() == 0
    assert lexical.digests(awkward, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_over_many_small_shards(spark, monkeypatch):
    docs = [(i, f"copy of the text {i % 3}") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([("q", "copy 1", ""), ("r", "text text 2", "")], ITEMS)
    same(frame, items)


@pytest.mark.parametrize("visit", [1, 8, 256])
def test_pruned_visits_equal_full_scores(visit, monkeypatch):
    monkeypatch.setattr(stratum_index, "VISIT", visit)
    draw = random.Random(visit)
    texts = [" ".join(f"w{int(draw.paretovariate(0.7)) % 60}" for _ in range(draw.randrange(120))) for _ in range(500)]
    words = words_of(*raw(pa.array(texts, pa.large_string())))
    n = np.diff(words.first)
    best = stratum_index.Best(1, 10)
    parts = stratum_index.built(words, np.arange(500), int((n > 0).sum()), int(n.sum()))
    for _ in range(20):
        query = sorted({f"w{draw.randrange(60)}" for _ in range(5)})
        hashes = words_of(*raw(pa.array(query, pa.large_string()))).hash
        order = np.argsort(hashes)
        weight = np.array([draw.randrange(1, 5000) for _ in query])
        items = stratum_index.Items(np.array([0, len(query)]), hashes[order], weight[order])
        best = stratum_index.Best(1, 10)
        stratum_index.Shard(parts).search(items, best)
        scored = []
        for i, text in enumerate(texts):
            c, m = Counter(text.split()), 75 + (25 * int(n[i]) * int((n > 0).sum())) // int(n.sum())
            s = sum(int(w) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, w in zip(query, weight, strict=True) if c[t])
            scored.append((-s, i))
        expected = [(i, -s) for s, i in sorted(scored)[:10] if s]
        assert [(d, s) for d, s in zip(best.doc[0].tolist(), best.score[0].tolist(), strict=True) if s] == expected


def test_documents_of_one_stratum_share_their_normaliser(spark):
    row = lexical.build(from_folder(spark, "documents")).shards.first()
    assert sorted(set(row["strata"])) == row["strata"] and sum(row["stratum_docs"]) == len(row["docs"])
    assert sum(row["term_groups"]) == len(row["group_tf"]) and sum(row["group_docs"]) == len(row["postings"])


def test_each_shard_is_a_row_group_of_its_own(spark):
    text = F.repeat(F.concat_ws(" ", F.lit("common word"), "id", F.lit("")), 300_000).alias("text")
    docs = spark.range(3).coalesce(1).select(F.col("id").alias("doc_id"), text)
    index = lexical.build(docs)
    (file,) = {r[0] for r in index.shards.select(F.input_file_name()).collect()}
    footer = pq.ParquetFile(file.removeprefix("file:").replace("//", "/")).metadata
    assert [footer.row_group(i).num_rows for i in range(footer.num_row_groups)] == [1, 1, 1]
    same(docs, spark.createDataFrame([("q", "common 1", ""), ("r", "2 word", "")], ITEMS))


def test_a_shard_takes_about_eight_bytes_a_posting(spark):
    types = dict(lexical.build(from_folder(spark, "documents")).shards.dtypes)
    wide = {"array<bigint>": 8, "array<int>": 4, "array<smallint>": 2}
    of_postings = [n for n in types if n.startswith("group_")] + ["postings"]
    assert sum(wide[types[n]] for n in of_postings) == 8


def test_a_batch_of_more_documents_than_a_shard_may_have(spark):
    most = stratum_index.MOST_DOCS
    assert list(slices(np.arange(2 * most + 2), 1 << 20, most)) == [(0, most), (most, 2 * most), (2 * most, 2 * most + 1)]
    text = F.when(F.col("id") % 1000 == 999, F.lit("rare a")).otherwise(F.lit("a b"))
    docs = spark.range(70_000).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, "0")
    try:
        sizes = [len(r["docs"]) for r in lexical.build(docs).shards.select("docs").collect()]
        assert sorted(sizes) == [70_000 - 2 * most, most, most]
        same(docs, spark.createDataFrame([("q", "rare", ""), ("r", "a b", "")], ITEMS))
    finally:
        spark.conf.unset(setting)
