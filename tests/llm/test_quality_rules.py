from __future__ import annotations

import re
from collections import Counter

import pytest
from corpus_cases import from_folder, prose

from quarrymark.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + 8)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def same(docs) -> None:
    # repeated rows and null ids: compare as multisets
    got = Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in rules.report(docs).collect())
    assert got == Counter((r["doc_id"], *by_hand(r["text"])) for r in docs.collect())


def test_against_plain_code(spark):
    same(from_folder(spark, "documents"))


def test_awkward(awkward):
    same(awkward)


def test_empty(nothing):
    assert rules.report(nothing).count() == 0 and rules.keep_good(nothing).columns == nothing.columns


def test_keeps_columns_and_good_documents(awkward):
    kept = rules.keep_good(awkward)
    assert kept.columns == awkward.columns
    report = Counter(r["doc_id"] for r in rules.report(awkward).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == report


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        (prose(50), True),
        (prose(19), False),
        (" ".join(w + "%%%" for w in prose(50).split()), False),
        (" ".join(w + "!!" for w in prose(50).split()), False),
        (" | ".join(prose(50).split()), False),
        ("one more line\n" * 30, False),
        ("the words of a text in which no two windows agree " + " ".join(f"w{i}" for i in range(100)), True),
        (" ".join(f"w{i}" for i in range(100)), False),
    ],
)
def test_verdicts(spark, text, kept):
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert rules.report(docs).first()["kept"] is kept


def test_unknown_language_needs_no_stop_words(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text, "fi"), (2, text, None)], "doc_id long, text string, lang string")
    assert rules.report(docs).where("kept").count() == 2


def test_one_projection_without_functions_of_the_user(spark):
    plan = rules.report(from_folder(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
