from __future__ import annotations

from collections import Counter

import corpus_pipeline
from corpus_cases import from_folder

from quarrymark.llm import decontamination, histogram_sort, quality_rules, queries, simhash, store

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = from_folder(spark, "documents")
    columns = docs.columns
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, seen, FOLDER)
        if name != "sharding":
            assert after.columns == columns and after.schema == docs.schema
            ids = Counter(r["doc_id"] for r in after.select("doc_id").collect())
            assert not ids - Counter(r["doc_id"] for r in seen.select("doc_id").collect())
        if name == "quality_rules":
            good = Counter(r["doc_id"] for r in quality_rules.report(seen).where("kept").collect())
            assert ids == good and sum(ids.values()) < docs.count()
        if name == "near_dedup":
            assert Counter(set(r["component_id"] for r in simhash.digests(seen).collect())) == ids
        if name == "decontamination":
            items = from_folder(spark, "benchmark")
            assert decontamination.digests(seen, items).where("contaminated").count() > 0
            assert decontamination.digests(after, items).where("contaminated").count() == 0
        seen = store.written(after, f"test-{name}")
    assert seen.columns == [*columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    ran = corpus_pipeline.run(spark, FOLDER)
    rows = ran.select(*columns, "size", "shard", "slot").collect()
    assert Counter(tuple(r)[: len(columns)] for r in rows) == Counter(tuple(r) for r in seen.select(*columns).collect())
    slots = {}
    for r in rows:
        assert r["size"] == len(r["text"].encode()) + 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_the_documents_are_those_of_the_manifest(spark, awkward):
    for docs in (from_folder(spark, "documents"), store.written(awkward, "awkward")):
        whole = histogram_sort.sharded(docs)
        key = ("size", "text_crc32", "law", "shard", "slot")
        assert Counter(tuple(r[c] for c in key) for r in whole.collect()) == Counter(
            tuple(r[c] for c in key) for r in histogram_sort.manifest(docs).collect()
        )
        texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        assert Counter((r["doc_id"], r["text"]) for r in whole.collect()) == texts


def test_intermediate_tables_are_removed(spark):
    import os

    place = store.folder(spark, "probe").rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(place))
    corpus_pipeline.run(spark, FOLDER).count()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(place)) - before}
    assert left == {"mixing", "sort-keys"}


def test_names_of_the_operators_may_be_columns(spark):
    from pyspark.sql import functions as F

    taken = ("_quality", "__dedup_hash", "__dedup_place", "__mix_id", "__keep_id", "row", "size", "block")
    docs = from_folder(spark, "documents").select("*", *[F.lit("x").alias(c) for c in taken])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert all(c in docs.columns for c in taken) and docs.count() > 0, name


def test_stages_on_awkward_documents(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() <= docs.count()


def test_all_operators_are_registered(spark):
    import __spark_entry__ as contract

    named = contract.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14)) and "pipeline" in named
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_sql_agrees(spark):
    import compare

    con = compare.connect(FOLDER)
    for name, sql in queries.SQL.items():
        frame = queries.QUERIES[name](spark, FOLDER)
        rel = con.sql(sql)
        assert sorted(frame.columns) == sorted(rel.columns)
        assert compare.canonical(frame.columns, [tuple(r) for r in frame.collect()]) == compare.canonical(rel.columns, rel.fetchall())
