"""Section trees, chunks and interval joins against plain code."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrymark.operators import intervals, sections

HEADS = "doc_id long, block int, level int, number string, title string"


def plain_tree(heads: list[tuple]) -> list[tuple]:
    """(block, section_id, parent_id, path) with a stack."""
    stack, children, used, out = [], {}, {}, []
    numbered = any(n is not None for _, _, _, n, _ in heads)
    for _, block, level, number, title in heads:
        while stack and stack[-1][0] >= level:
            stack.pop()
        key = stack[-1][3] if stack else None
        children[key] = children.get(key, 0) + 1
        derived = (stack[-1][1] if stack else []) + [str(children[key])]
        base = number if number is not None else ("u" if numbered else "") + ".".join(derived)
        used[base] = used.get(base, 0) + 1
        sid = base if used[base] == 1 else f"{base}-{used[base]}"
        path = (stack[-1][2] if stack else []) + [title]
        out.append((block, sid, stack[-1][4] if stack else None, path))
        stack.append((level, derived, path, block, sid))
    return out


def test_tree_equals_a_stack(spark):
    draw = random.Random(3)
    rows = []
    for doc in range(60):
        at = 0
        for i in range(draw.randrange(1, 25)):
            at += draw.randrange(1, 4)
            number = f"{draw.randrange(3)}.{draw.randrange(3)}" if draw.random() < 0.2 * (doc % 2) else None
            rows.append((doc, at, draw.randrange(1, 8), number, f"t{i % 5}"))
    got = sections.tree(spark.createDataFrame(rows, HEADS)).collect()
    for doc in range(60):
        mine = sorted((r["block"], r["section_id"], r["parent_id"], r["path"]) for r in got if r["doc_id"] == doc)
        assert mine == plain_tree([r for r in rows if r[0] == doc])


def test_no_headings_at_all(spark):
    assert sections.tree(spark.createDataFrame([], HEADS)).count() == 0


def found(spark, text: str) -> list[tuple]:
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sections.sections(docs).orderBy("ordinal").collect()
    return [(r["section_id"], r["level"], r["title"], r["path"], (text or "")[r["start"] : r["end"]], r["n_paragraphs"]) for r in rows]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Before.\n\n# A\n\nOne.\n\nTwo.\n\n## B\n\nThree.\n\n# C\n\nFour.",
         [("0", 0, "", [], "Before.", 1), ("1", 1, "A", ["A"], "One.\n\nTwo.", 2), ("1.1", 2, "B", ["A", "B"], "Three.", 1), ("2", 1, "C", ["C"], "Four.", 1)]),
        ("# Title\n\nLead.\n\n## B\n\nText.", [("0", 0, "Title", [], "Lead.", 1), ("1", 2, "B", ["B"], "Text.", 1)]),
        ("Early.\n\n# Title\n\nLead.\n\n## B\n\nText.", [("0", 0, "Title", [], "Early.\n\n# Title\n\nLead.", 2), ("1", 2, "B", ["B"], "Text.", 1)]),
        ("# Only\n\nBody.", [("1", 1, "Only", [], "Body.", 1)]),
        ("Just text.\n\nMore.", [("1", 1, "", [], "Just text.\n\nMore.", 2)]),
        ("OPENING HOURS\n\nNine to five.", [("1", 1, "Opening Hours", ["Opening Hours"], "Nine to five.", 1)]),
        ("Read on.\n\n1. Alpha\n\n2. Beta\n\n3. Gamma", [("1", 1, "", [], "Read on.\n\n1. Alpha\n\n2. Beta\n\n3. Gamma", 4)]),
        ("# A\n\n# B\n\nText.", [("2", 1, "B", ["B"], "Text.", 1)]),
        ("", []),
        (None, []),
    ],
)
def test_sections_of_texts(spark, text, expected):
    assert found(spark, text) == expected


def test_chunks_are_slices_with_headers(spark):
    words = " ".join(f"Word{i} goes on here." for i in range(700))
    text = f"# Guide\n\nShort lead.\n\n## Long part\n\n{words}\n\nAnother paragraph.\n\n## End\n\nBye."
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    rows = sections.chunks(docs, sections.sections(docs)).collect()
    assert len({r["chunk_id"] for r in rows}) == len(rows) > 5
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rows)
    assert {r["header"] for r in rows} == {"Guide", "Guide > Long part", "Guide > End"}
    assert {w for r in rows for w in r["text"].split()} >= set(words.split()) | {"Bye."}
    first = next(r for r in rows if r["section_id"] == "0")
    assert first["chunk_id"] == "7#0#1" and first["text"] == "Short lead."


def plain_overlaps(rows: list[tuple]) -> set[tuple]:
    kept = [(k, i, s, e) for k, i, s, e in rows if k is not None and s is not None and e is not None and s < e]
    out = set()
    for k, i, s, e in kept:
        for k2, j, s2, e2 in kept:
            if k == k2 and (s, i) < (s2, j) and s2 < e:
                shared = min(e, e2) - s2
                out.add((k, i, j, shared, round(shared / min(e - s, e2 - s2), 6)))
    return out


def test_overlaps_equal_all_pairs(spark):
    draw = random.Random(9)
    rows = []
    for i in range(500):
        start = draw.randrange(-2000, 2000)
        rows.append((0 if draw.random() < 0.4 else draw.randrange(1, 5), i, start, start + int(draw.paretovariate(0.5)) % 3000))
    rows += [(9, 1, 0, 1), (9, 2, 0, 1), (9, 3, 1, 2), (9, 4, 0, 0), (9, 5, 5, 2), (9, 6, None, 4), (None, 7, 0, 9), (None, 8, 0, 9), (9, 10, -(2**40), 2**40)]
    frame = spark.createDataFrame(rows, "k int, i long, start long, end long")
    got = [tuple(r) for r in intervals.overlaps(frame, ["k"], "i").collect()]
    assert len(got) == len(set(got)) and {(*g[:4],) for g in got} == {(*p[:4],) for p in plain_overlaps(rows)}
    assert all(abs(g[4] - next(p[4] for p in plain_overlaps([r for r in rows if r[1] in g[1:3]]) if p[:4] == g[:4])) < 2e-6 for g in got[:50])


def test_long_intervals_make_few_rows(spark):
    rows = [(1, i, 0, 2**45 + i) for i in range(5)] + [(1, 10 + i, i * 1000, i * 1000 + 1) for i in range(5)]
    frame = spark.createDataFrame(rows, "k int, i long, start long, end long")
    assert intervals.overlaps(frame, ["k"], "i").count() == 10 + 25


def test_empty_intervals(spark):
    frame = spark.createDataFrame([], "k int, i long, start long, end long")
    assert intervals.overlaps(frame, ["k"], "i").count() == 0


def test_no_loop_joins(spark, tables):
    from quarrymark.plans.catalogue import CATALOGUE

    frame = CATALOGUE["interval_overlaps"].build(tables)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and isinstance(F.lit(1), object)
