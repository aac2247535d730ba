from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus_cases import from_folder, prose

from quarrymark.llm import decontamination as dec
from quarrymark.llm.fm_index import FMIndex, suffix_order
from quarrymark.llm.word_hashes import raw, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, window=10) -> Counter:
    known: dict[tuple, set] = {}
    for r in items:
        w = words(r["text"])
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(str(r["item_id"]))
    out = Counter()
    for d in docs:
        w, hit, found = words(d["text"]), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
                    found |= known[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d["doc_id"], len(w), len(hit), len(found), digest, bool(hit)] += 1
    return out


def same(docs, items) -> None:
    assert Counter(tuple(r) for r in dec.digests(docs, items).collect()) == by_hand(docs.collect(), items.collect())


def test_documents(spark):
    same(from_folder(spark, "documents"), from_folder(spark, "benchmark"))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, prose(40, 5)), (2, "Short item"), (3, None), (4, "..."), (5, prose(12, 30)), (6, prose(12, 30)), (11, prose(25, 3)), (11, "x")]
    return spark.createDataFrame([(*r, "e") for r in rows], "item_id long, text string, text_hash string")


def test_awkward(awkward, nothing, items):
    same(awkward, items)
    same(awkward, items.where("false"))
    assert dec.digests(nothing, items).count() == 0


def test_hits_at_edges_and_across_documents(spark, items):
    a = prose(40, 5).split()
    rows = [
        (1, " ".join(a[:5])),
        (2, " ".join(a[5:])),
        (3, "before " + "! -- ".join(a) + " after"),
        (4, "SHORT, ITEM"),
        (5, "short"),
        (6, "item short item short"),
        (7, " ".join(a[:9])),
        (8, " ".join(a[:10])),
    ]
    same(spark.createDataFrame(rows, "doc_id long, text string"), items)


def test_small_shards_and_parts_change_nothing(spark, awkward, items, monkeypatch):
    docs = from_folder(spark, "documents").limit(60).collect()
    files = dec.prepare(from_folder(spark, "benchmark"))
    column = __import__("pyarrow").array([d["text"] for d in docs])
    data, at = raw(column)
    whole = dec._find(words_of(data, at), files)
    pieces = [dec._find(words_of(data, at[i : i + 2]), files) for i in range(len(docs))]
    assert np.array_equal(whole[0], np.concatenate([p[0] for p in pieces])) and whole[1] == [p[1][0] for p in pieces]
    monkeypatch.setattr(dec, "PART_BYTES", 2000)
    parts = dec.prepare(from_folder(spark, "benchmark"))
    assert len(parts) > 3
    split = dec._find(words_of(data, at), parts)
    assert np.array_equal(whole[0], split[0]) and whole[1] == split[1]


def test_cleaned_texts_hold_no_window(spark, items):
    a = prose(40, 5)
    other = " ".join(f"own{i}" for i in range(30))
    left, right = a.split()[:6], a.split()[6:14]
    rows = [
        (1, f"clean start {a} clean end", 3),
        (2, a, 3),
        (3, other, 3),
        (4, " ".join(left) + " " + a + " " + " ".join(right), 3),  # the ends form an occurrence once the middle is cut
        (5, None, None),
        (6, "", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    clean = dec.cleaned(docs, items)
    got = {r["doc_id"]: r for r in clean.collect()}
    assert clean.schema == docs.schema and set(got) == {1, 3, 5, 6}
    assert got[1]["text"].split() == ["clean", "start", "clean", "end"] and got[1]["n_chars"] == len(got[1]["text"])
    assert got[3]["text"] == other and got[5]["text"] is None
    assert dec.digests(clean, items).where("contaminated").count() == 0


def test_spans_are_merged(spark, items):
    a = prose(40, 5)
    docs = spark.createDataFrame([(1, f"é {a} é")], "doc_id long, text string")
    (span,) = dec.report(docs, items).first()["spans"]
    assert f"é {a} é".encode()[span["start"] : span["end"]].decode() == a


def test_index_against_plain_search():
    rng = random.Random(3)
    for _ in range(30):
        passages = [[rng.randint(1, 4) for _ in range(rng.randint(1, 80))] for _ in range(rng.randint(1, 6))]
        symbols = np.array([s for p in passages for s in [*p, 0]])
        index = FMIndex(symbols, 4)
        order = suffix_order(symbols)
        key = lambda i: [(0, i) if s == 0 else (1, s) for i, s in enumerate(symbols.tolist())][i:]
        assert order.tolist() == sorted(range(len(symbols)), key=key)
        for size in (1, 2, 3, 5):
            patterns = np.array([[rng.randint(1, 4) for _ in range(size)] for _ in range(20)])
            which, low, high = index.search(patterns)
            found = dict(zip(which.tolist(), zip(low, high, strict=True), strict=True))
            for i, p in enumerate(patterns):
                places = [k for k in range(len(symbols) - size + 1) if symbols[k : k + size].tolist() == p.tolist()]
                rows = np.arange(*found[i]) if i in found else np.zeros(0, int)
                assert sorted(index.locate(rows).tolist()) == places


def test_items_do_not_pass_through_the_driver(spark, monkeypatch):
    items = from_folder(spark, "benchmark")
    monkeypatch.setattr(dec, "PART_BYTES", 2000)
    seen = []
    collect = type(items).collect

    def watched(frame):
        rows = collect(frame)
        seen.extend(rows)
        return rows

    monkeypatch.setattr(type(items), "collect", watched)
    files = dec.prepare(items)
    values = [v for r in seen for v in r]  # the size of the table, and a name a part
    assert len(files) > 1 and sorted(v for v in values if not isinstance(v, int)) == files and len(values) == len(files) + 1
    ids = [i for f in files for i in np.load(dec.place(f)[1])["ids"]]
    assert Counter(ids) == Counter(str(r["item_id"]) for r in collect(items))
