"""User-stated filters against plain code."""

from __future__ import annotations

import random
import re

from quarrymark.operators import stated

MARKERS = ["under", "for", "only"]


def plain(questions: list[tuple], values: list[tuple]) -> set[tuple]:
    out = set()
    for qid, text, constraint in questions:
        ws, cs = (re.findall(stated.WORD, (x or "").lower()) for x in (text, constraint))
        for field, value in set(values):
            ts = re.findall(stated.WORD, (value or "").lower())
            at = [i for i in range(len(ws)) if ts and ws[i : i + len(ts)] == ts]
            inside = bool(ts) and set(ts) <= set(cs)
            marked = any(m in ws[max(0, i - 3) : i] for i in at for m in MARKERS)
            if at and (inside or marked):
                out.add((qid, field, value, len(at), inside, marked))
    return out


def test_against_plain_code(spark):
    draw = random.Random(2)
    pool = ["fee", "permit", "under", "for", "type-a", "2024", "only", "city", "x"]
    phrase = lambda n: " ".join(draw.choice(pool) for _ in range(n))
    questions = [(i, phrase(draw.randrange(12)), phrase(draw.randrange(4)) if i % 3 else None) for i in range(120)]
    questions += [(200, None, None), (201, "Under the City: FEE!", "city fee"), (202, "", "")]
    values = [("a", phrase(draw.randrange(1, 4))) for _ in range(40)] + [("b", "City"), ("b", "city fee"), ("c", ""), ("c", None), ("a", "fee fee")]
    q = spark.createDataFrame(questions, "qid long, text string, constraint string")
    v = spark.createDataFrame(values, "field string, value string")
    got = [tuple(r) for r in stated.stated(q, v, MARKERS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(questions, values)


def test_a_value_without_a_marker_is_no_filter(spark):
    v = spark.createDataFrame([("kind", "residential")], "field string, value string")
    ask = lambda text, c=None: stated.stated(spark.createDataFrame([(1, text, c)], "qid long, text string, constraint string"), v, MARKERS).count()
    assert ask("residential permits are cheap") == 0
    assert ask("permits only for residential use") == 1
    assert ask("for all of these three residential permits") == 0
    assert ask("residential permits", "Residential") == 1


def test_empty(spark):
    q = spark.createDataFrame([], "qid long, text string, constraint string")
    v = spark.createDataFrame([], "field string, value string")
    assert stated.stated(q, v, MARKERS).count() == 0


def test_words_are_counted_before_they_are_shuffled(spark, tmp_path):
    """Before, every place at which a question says a word of a value was shuffled with the value."""
    spark.range(40).selectExpr("id AS qid", "repeat('for the fee ', 50) AS text", "'' AS constraint").write.parquet(str(tmp_path / "q"))
    v = spark.createDataFrame([("kind", "fee"), ("kind", "the fee")], "field string, value string")
    rows = stated.stated(spark.read.parquet(str(tmp_path / "q")), v, MARKERS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[qid#\d+L?, phrase#\d+\], functions=\[partial_count", plan) and "start#" not in plan
    assert {(r.value, r.n_found, r.by_marker) for r in rows.collect()} == {("fee", 50, True), ("the fee", 50, True)}
