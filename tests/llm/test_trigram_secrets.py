from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from corpus_cases import from_folder

from quarrymark.llm import trigram_secrets as sec
from quarrymark.llm.trigram_queries import ANYTHING, Query, derive

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: m.end() - m.start() >= 24),
]
COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]


def same(docs) -> None:
    want = Counter()
    for d in docs.collect():
        spans = sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(KINDS) for m in p.finditer(d["text"] or "") if ok(m))
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()
        want[d["doc_id"], *(sum(x[2] == k for x in spans) for k, *_ in KINDS), digest] += 1
    assert Counter(tuple(r) for r in sec.digests(docs).select(COLUMNS).collect()) == want


def test_documents(spark):
    same(from_folder(spark, "documents"))


def test_awkward(awkward, nothing):
    same(awkward)
    assert sec.digests(nothing).count() == 0


def test_random_texts(spark):
    rng = random.Random(5)
    bits = ["password", "PassWD", "secret", "ToKeN", "apikey", "API_KEY", '"', "'", " ", " ", ":", "=", "abc123", "+/", "AKIA", "Z" * 16, "f" * 23, "0a", "é", "ſecret", "toKen"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(4000)]
    same(spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_trigram_across_two_documents_is_no_candidate(spark):
    docs = spark.createDataFrame([(1, "xx AK"), (2, "IA" + "Z" * 20)], "doc_id long, text string").coalesce(1)
    assert [r["n_verified"] for r in sec.found(docs).orderBy("doc_id").collect()] == [1, 1]  # only the full-scan rule


def test_candidates_are_few(spark):
    docs = from_folder(spark, "documents", "/root/testdata/sf0.01")
    assert sec.found(docs).agg({"n_verified": "sum"}).first()[0] < 1.1 * docs.count()


def holds(query, text: bytes) -> bool:
    if isinstance(query, bytes):
        return query in text
    return (any if query.kind == "any" else all)(holds(p, text) for p in query.parts)


@pytest.mark.parametrize(
    ("pattern", "texts"),
    [
        (r"abc(d|e)f", ["abcdf", "abcef"]),
        (r"(?:foo|bar)?bazaar", ["bazaar", "foobazaar"]),
        (r"a(bcd)+e", ["abcde", "abcdbcde"]),
        (r"x[0-9]{3}yes", ["x123yes"]),
        (r"hel*o wo.ld", ["heo world", "hello wo!ld"]),
        (r"(?i)SeCrEt_[a-c]x", ["secret_ax", "SECRET_BX"]),
        (r"key\s*=\s*(?=v)value", ["key = value"]),
        (r"(?:one|two|three){2}", ["onetwo", "threethree"]),
        (r"^start.*end$", ["start and end"]),
    ],
)
def test_queries_never_miss(pattern, texts):
    query = derive(re.compile(pattern))
    for text in texts:
        assert re.search(pattern, text) and holds(query, text.lower().encode())


def test_query_shapes():
    assert derive(re.compile("AKIA[A-Z0-9]+")) == Query("all", frozenset({b"aki", b"kia"}))
    assert derive(re.compile("[0-9a-f]+")) == ANYTHING and derive(re.compile("ab|cdef")) == ANYTHING
    assert not holds(derive(re.compile("abc(d|e)f")), b"abcd dff")
