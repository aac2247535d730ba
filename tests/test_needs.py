"""Page edges and label brackets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrymark.operators import needs

PAGES = "book string, page long, text string"


def test_edges_go_and_inner_lines_stay(spark):
    rows = [("b", i, f"The Book {i}\n\nChapter\nline {i}\nThe Book {i}\nmore {i}\nend {i}\n- {i} -") for i in range(1, 6)]
    rows += [("two", i, f"Head\nbody {i}\n7") for i in (1, 2)] + [("none", 1, None), ("none", 2, ""), ("none", 3, "Page 3 of 9")]
    got = {(r["page"], tuple(r["removed"])): r["text"] for r in needs.without_edges(spark.createDataFrame(rows, PAGES), "book", "page").collect()}
    for i in range(1, 6):
        assert got[i, (f"The Book {i}", "Chapter", f"end {i}", f"- {i} -")] == f"\nline {i}\nThe Book {i}\nmore {i}"
    # two pages make no running header, page numbers go all the same
    assert got[1, ("7",)] == "Head\nbody 1" and got[3, ("Page 3 of 9",)] == ""
    assert got[1, ()] == "" and got[2, ()] == ""


def test_lines_that_recur_on_few_pages_stay(spark):
    rows = [("b", i, f"{'Notice' if i % 2 else f'Own start {chr(97 + i)}'}\ntext {i}\nlast {chr(97 + i)}") for i in range(10)]
    found = needs.without_edges(spark.createDataFrame(rows, PAGES), "book", "page").collect()
    assert all(r["removed"] == [] for r in found)


@pytest.mark.parametrize(
    ("text", "labels", "bare"),
    [
        ("It costs 5 [E1].", ["[E1]"], "It costs 5."),
        ("Both (E1, F2; E10) and [ F3 / E4 ] hold", ["(E1, F2; E10)", "[ F3 / E4 ]"], "Both and hold"),
        ("Not [E], (E1a), [e1], (see E1) or []", [], "Not [E], (E1a), [e1], (see E1) or []"),
        ("Nested ([E1]) stays a pair", ["[E1]"], "Nested () stays a pair"),
        ("", [], ""),
    ],
)
def test_label_brackets(spark, text, labels, bare):
    row = spark.createDataFrame([(text,)], "t string").select(needs.markers(F.col("t")), needs.without_markers(F.col("t"))).first()
    assert row[0] == labels and row[1] == bare


def test_labels_are_found_once_a_text(spark):
    """Before, every bracket of a text was looked up in the whole text again."""
    frame = spark.createDataFrame([("a [E1]  . b (x) [F2; E3]   c [E4",), ("",), (None,)], "text string")
    rows = frame.select(needs.without_markers(F.col("text")).alias("bare"))
    assert [r[0] for r in rows.collect()] == ["a. b (x)   c [E4", "", None]
    plan = rows._jdf.queryExecution().optimizedPlan().treeString()
    assert plan.count("[^\\[\\]()]*") == 2 and "get(" not in plan  # split once, extracted once, and no look-up by place
