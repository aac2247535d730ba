from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from quarrymark.config import RETRIEVAL, override
from quarrymark.operators import lexical
from quarrymark.sources import corpus, index, records


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "sub").mkdir()
    (root / "a.md").write_text('---\ntitle: "Permit guide"\nid: P-1\neffective_date: 2026-01-01T00:00:00\napplicant_type: [domestic, international]\nsecret: x\n---\n# Permit\n\nBody.\n', encoding="utf-8")
    (root / "sub" / "b.txt").write_bytes("﻿café".encode("utf-8"))
    (root / "sub" / "c.txt").write_bytes("café".encode("cp1252"))
    (root / "empty.txt").write_text("  \n")
    (root / "d.pdf").write_bytes(b"%PDF-1.4")
    (root / ".hidden.txt").write_text("no")
    (root / "x.exe").write_text("no")
    return str(root)


def test_scan_and_load(spark, folder):
    rows = {r.name: r for r in corpus.load(corpus.scan(spark, folder)).collect()}
    assert set(rows) == {"a.md", "b.txt", "c.txt", "empty.txt", "d.pdf"}
    assert rows["b.txt"].text == "café" and rows["c.txt"].text == "café"
    assert (rows["empty.txt"].status, rows["empty.txt"].reason) == ("skipped", "empty")
    assert rows["d.pdf"].status == "skipped" and rows["d.pdf"].text is None
    a = rows["a.md"]
    assert a.metadata == {"title": "Permit guide", "id": "P-1", "effective_date": "2026-01-01", "applicant_type": "domestic,international"}
    assert a.text.split("\n")[7] == "# Permit"
    ids = {r.name: r.document_id for r in corpus.document_ids(corpus.load(corpus.scan(spark, folder))).collect()}
    assert ids["a.md"] == "P-1" and ids["b.txt"] == "b"


def test_status_and_fingerprint(spark, folder, tmp_path):
    assert corpus.status(spark, str(tmp_path / "none")) == "NOT_AVAILABLE"
    assert corpus.status(spark, folder) == "AVAILABLE" and corpus.status(spark, folder, fixture=True) == "TEST_FIXTURE"
    prints = [corpus.fingerprint(corpus.scan(spark, folder), folder).first() for _ in range(2)]
    assert prints[0] == prints[1] and prints[0].n_files == 5
    assert corpus.fingerprint(corpus.scan(spark, folder), folder, fixture=True).first().corpus_hash != prints[0].corpus_hash


def test_records(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text(json.dumps({"item_id": "i1", "query": "q", "gold": ["d1"]}) + "\n")
    assert records.items(spark, str(tmp_path / "items.jsonl")).first().gold == ["d1"]
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception):
        records.items(spark, str(tmp_path / "bad.jsonl")).collect()
    case = {"case_id": "C1", "category": "x", "session": {"session_id": "s", "turns": [{"utterance_id": "u1", "chunks": [{"chunk_index": 0, "timestamp_s": 0.5, "text": "hi"}], "expected": {"intents": [
        {"gold_intent_id": "g1", "description": "fee", "answerable": True, "gold_evidence": ["d"]}, {"gold_intent_id": "g2", "description": "no", "answerable": False}]}}]}}
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases" / "c.json").write_text(json.dumps(case, indent=1))
    cases = records.cases(spark, str(tmp_path / "cases"))
    assert [r.item_id for r in records.case_items(cases).collect()] == ["C1:u1:g1"]
    assert records.case_feed(cases).first().text == "hi"


def test_replay(spark, tmp_path):
    base = [{"event_id": f"s:{i}", "type": "transcript_chunk" if i < 3 else "answer", "session_id": "s", "utterance_id": "u", "seq": i, "t_wall_ms": 1.0 * i, "payload": json.dumps({"chunk_index": i, "text": f"t{i}"})} for i in range(4)]
    for name, shift in (("a", 0), ("b", 100)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({**e, "t_wall_ms": e["t_wall_ms"] + shift}) for e in base))
    a, b = (records.trace(spark, str(tmp_path / f"{n}.jsonl")) for n in "ab")
    assert records.differences(a, b).count() == 0
    assert [r.text for r in records.replay_inputs(a).orderBy("seq").collect()] == ["t0", "t1", "t2"]
    changed = b.withColumn("payload", F.when(F.col("seq") == 1, "{}").otherwise(F.col("payload")))
    assert records.differences(a, changed).count() == 2


def test_index_equals_scan_and_checks_itself(spark, tables, tmp_path):
    root = str(tmp_path)
    folder = index.build(tables.documents, root)
    assert index.build(tables.documents, root) == folder
    queries = tables.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    opened = index.LexicalIndex(spark, folder)
    found = opened.search(queries)
    want = lexical.bm25_top(lexical.Texts(tables.documents), queries)
    assert found.select(want.columns).exceptAll(want).count() == 0 and found.count() == want.count()
    other = index.build(tables.documents.where("doc_id <> 1"), root)
    assert other != folder
    with pytest.raises(index.IndexUnavailable, match="other options"):
        index.LexicalIndex(spark, folder, index.Options(k1=1.2))
    whole = opened.terms.cache()
    whole.count()
    whole.withColumn("df", F.when(F.col("term") == whole.first().term, F.col("df") + 1).otherwise(F.col("df"))).write.mode("overwrite").parquet(f"{folder}/terms")
    with pytest.raises(index.IndexUnavailable, match="terms: content differs"):
        index.LexicalIndex(spark, folder)
    whole.limit(3).write.mode("overwrite").parquet(f"{folder}/terms")
    with pytest.raises(index.IndexUnavailable, match="terms: 3 rows"):
        index.LexicalIndex(spark, folder)
    whole.unpersist()
    with pytest.raises(index.IndexUnavailable, match="no finished index"):
        index.LexicalIndex(spark, root + "/nothing")


def test_options():
    assert override(RETRIEVAL, {"top_k": 3}, {"top_k": 4}).top_k == 4
    with pytest.raises(ValueError, match="unknown"):
        override(RETRIEVAL, {"topk": 3})


def test_blocks_of_awkward_documents(spark, tmp_path):
    """Null, empty and repeated texts; blocks hold what counting the texts anew gives."""
    rows = [(i, f"alpha beta{i % 7} alpha gamma{i}") for i in range(300)] + [(900, None), (901, ""), (902, "alpha"), (None, "alpha delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    opened = index.LexicalIndex(spark, index.build(docs, str(tmp_path / "index")))
    key = lambda r: (r.doc_id is not None, r.doc_id, r.dl, r.term, r.tf)
    assert sorted(map(key, opened.postings().collect())) == sorted(map(key, lexical.postings(docs).select("doc_id", "dl", "term", "tf").collect()))
    assert {r.doc_id: r.dl for r in opened.lengths().collect()}[900] is None and opened.manifest["n"] == 304
    for block in opened.blocks.collect():
        assert [e.doc_id for e in block.entries] == sorted((e.doc_id for e in block.entries), key=lambda d: (d is not None, d))
        assert block.df == len(block.entries) and block.cf == sum(e.tf for e in block.entries)
        part = max(lexical.weight(e.tf, e.dl, 1.0, opened.manifest["avg_dl"]) for e in block.entries)
        assert block.top == pytest.approx(part, abs=1e-12)


def test_no_posting_is_shuffled_to_build_the_index(spark, tmp_path, monkeypatch):
    """Before, every posting went through an exchange by term and range."""
    docs = spark.createDataFrame([(i, f"alpha beta{i}") for i in range(50)], "doc_id long, text string")
    plans = []
    kind = type(spark.range(0).write)
    write = kind.parquet
    monkeypatch.setattr(kind, "parquet", lambda self, path, *a, **k: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), write(self, path, *a, **k))[1])
    index.build(docs, str(tmp_path / "index"))
    blocks = next(plan for path, plan in plans if path.endswith("/blocks"))
    assert "MapInArrow" in blocks and not re.search(r"Exchange hashpartitioning\([^)]*term", blocks)
