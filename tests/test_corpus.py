"""Line, section and chunk rules against plain reference code written for the tests."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrymark.operators import corpus


def one(spark, column, text):
    return spark.createDataFrame([(text,)], ["t"]).select(column).first()[0]


def test_normalise(spark):
    assert one(spark, corpus.basic_normalise(F.col("t")), "a\t b  c \r\n  d​e\r") == "a b c\nde\n"
    assert one(spark, corpus.drop_repeated_lines(F.col("t")), "a\na\n\na\nb\na") == "a\n\nb\na"
    assert one(spark, corpus.dehyphenate(F.col("t")), "infor-\nmation A-\nB") == "information A-\nB"


def test_join_wrapped(spark):
    text = "# Title\nfirst line of\na paragraph\n- item one\ncontinues\n- item two\n\n2. Opening Hours\nbody text\ngoes on"
    assert one(spark, corpus.join_wrapped(F.col("t")), text) == (
        "# Title\n\nfirst line of a paragraph\n- item one continues\n- item two\n\n2. Opening Hours\n\nbody text goes on"
    )


@pytest.mark.parametrize(
    "line, want",
    [
        ("## 3.1 Fees ##", ("markdown", 2, "3.1", "Fees")),
        ("# Guide", ("markdown", 1, None, "Guide")),
        ("§ 4.2 - Appeals", ("section_sign", 2, "4.2", "Appeals")),
        ("Section 7: Storage", ("section_word", 1, "7", "Storage")),
        ("1.2.3 Opening Hours", ("numbered", 3, "1.2.3", "Opening Hours")),
        ("2. this is body", None),
        ("3. Ends like a sentence.", None),
        ("plain text", None),
    ],
)
def test_headings(spark, line, want):
    got = one(spark, corpus.heading(F.col("t")), line)
    assert (tuple(got) if got is not None else None) == want


def test_caps_heading(spark):
    assert one(spark, corpus.caps_heading(F.col("t")), "OPENING HOURS")["title"] == "Opening Hours"
    assert one(spark, corpus.caps_heading(F.col("t")), "OK") is None


def test_sections(spark):
    text = "Intro\n\n# A\n\nbody\n\n## B\n\nbody\n\n## C\n\n# D\n\n1. One\n\n2. Two\n\n3. Three\n\nend"
    tree = one(spark, corpus.section_tree(F.split("t", r"\n\n")), text)
    assert [(s.sid, s.parent, s.path) for s in tree] == [
        ("1", None, ["A"]), ("1.1", "1", ["A", "B"]), ("1.2", "1", ["A", "C"]), ("2", None, ["D"]),
    ]
    native = one(spark, corpus.section_tree(F.split("t", r"\n\n")), "# 5 Five\n\nx\n\n## Sub\n\nx\n\n# 5 Again\n\nx")
    assert [s.sid for s in native] == ["5", "u1.1", "5-2"]


def test_pages(spark):
    pages = F.array(F.lit("One ends."), F.lit("Two runs"), F.lit("on here"))
    offsets = corpus.page_offsets(pages)
    got = spark.range(1).select(offsets.alias("o")).select(
        "o", *[corpus.page_at(F.col("o"), F.lit(p)).alias(f"p{p}") for p in (0, 9, 12, 20, 99)]
    ).first()
    assert [tuple(o) for o in got.o] == [(1, 0, 9), (2, 11, 19), (3, 20, 27)]
    assert (got.p0, got.p9, got.p12, got.p20, got.p99) == (1, 1, 2, 3, 3)


def test_sentences(spark):
    text = 'Dr. Smith pays 3.50 euros. He left. e.g. This stays? "Yes." And\n- item one\n- item two'
    got = [s.text for s in one(spark, corpus.sentence_spans(F.col("t")), text)]
    assert got == ["Dr. Smith pays 3.50 euros.", "He left. e.g. This stays?", '"Yes."', "And", "- item one", "- item two"]
    for s in one(spark, corpus.sentence_spans(F.col("t")), text):
        assert text[s.start : s.end] == s.text


def plain_pack(units, target, maximum, minimum, overlap):
    """units: (start, end, tokens, paragraph, first)."""
    groups, cur = [], []
    for i, u in enumerate(units):
        total = sum(units[j][2] for j in cur)
        if not cur or total + u[2] <= target or (total + u[2] <= maximum and total < minimum):
            cur.append(i)
            continue
        groups.append(cur)
        start = i
        if not u[4]:
            while start > cur[0] and units[start - 1][3] == u[3] and sum(units[j][2] for j in range(start - 1, i)) <= min(overlap, maximum - u[2]):
                start -= 1
        cur = list(range(start, i + 1))
    if cur:
        groups.append(cur)
    if len(groups) > 1:
        tokens = lambda a, b: sum(units[j][2] for j in range(a, b + 1))
        if tokens(groups[-1][0], groups[-1][-1]) < minimum and tokens(groups[-2][0], groups[-1][-1]) <= maximum:
            groups[-2:] = [list(range(groups[-2][0], groups[-1][-1] + 1))]
    return [(units[g[0]][0], units[g[-1]][1]) for g in groups]


def test_chunks_against_plain_code(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        paras = []
        for _ in range(rng.randint(1, 6)):
            sents = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 14))).capitalize() + "." for _ in range(rng.randint(1, 6))]
            paras.append(" ".join(sents))
        texts.append("\n".join(paras))
    cfg = dict(target=20, maximum=30, minimum=5, overlap=8)
    units = corpus.chunk_units(F.col("t"), maximum=cfg["maximum"])
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", "t", corpus.pack_units(units, **cfg).alias("c"))
    count = lambda s: len(re.findall(r"\w+", s))
    for row in frame.collect():
        expected, pos = [], 0
        for p, para in enumerate(row.t.split("\n")):
            if count(para) <= cfg["maximum"]:
                expected.append((pos, pos + len(para), count(para), p, True))
            else:
                for k, m in enumerate(re.finditer(r"\S[^.]*\.", para)):
                    expected.append((pos + m.start(), pos + m.end(), count(m.group()), p, k == 0))
            pos += len(para) + 1
        assert [(c.start, c.end) for c in row.c] == plain_pack(expected, cfg["target"], cfg["maximum"], cfg["minimum"], cfg["overlap"])
        assert all(count(row.t[c.start : c.end]) <= cfg["maximum"] for c in row.c)


def test_run_on_sentence_is_cut(spark):
    text = " ".join(f"w{i}" for i in range(700))
    got = one(spark, corpus.pack_units(corpus.chunk_units(F.col("t"))), text)
    assert [len(text[c.start : c.end].split()) for c in got] == [300, 300, 100] and [c.mid for c in got] == [False, True, True]


def test_word_windows_close_at_the_end(spark):
    got = one(spark, corpus.word_windows(F.col("t"), 4, 1), "a b c d e f g h")
    assert [w.text for w in got] == ["a b c d", "d e f g", "g h"]
    assert one(spark, corpus.word_windows(F.col("t"), 4, 1), "...") == []


def test_html(spark):
    html = "<html><head><title>x</title></head><body><h2>Top</h2><p>a &lt; b &amp; c<script>var x;</script></p><ul><li>one</li></ul></body></html>"
    assert one(spark, corpus.html_text(F.col("t")), html) == "## Top\n\na < b & c\n\n- one"


def test_edges_that_recur_and_page_numbers_go(spark):
    from quarrymark.operators import needs

    body = "\n".join(f"line {c}" for c in "abcdefgh")
    rows = [("s", i, f"Report 2024\n{body}{i}\nSite footer\n{i}") for i in range(4)] + [("u", 9, "Report 2024\nx\ny\nSite footer")]
    frame = spark.createDataFrame(rows, "source string, doc_id long, text string")
    got = {r.doc_id: (r.n_repeated, r.n_page_numbers, r.lines) for r in needs.edge_removals(frame, "source", "doc_id").collect()}
    # the second line from the top recurs as well; page numbers recur under one key
    assert got[1] == (4, 0, ["1", "Report 2024", "Site footer", "line a"]) and got[9] == (0, 0, [])


def test_markers_go_with_their_blanks(spark):
    from quarrymark.operators import needs

    frame = spark.createDataFrame([("The fee is 5 (E1), paid twice [E2, F3] .",)], ["t"])
    row = frame.select(needs.without_markers(F.col("t")).alias("t"), needs.markers(F.col("t")).alias("m")).first()
    assert row.t == "The fee is 5, paid twice." and row.m == ["(E1)", "[E2, F3]"]


def test_constraints_are_set_repeated_and_updated(spark):
    from quarrymark.operators import needs

    rows = [(1, 0, 0, ["adult", "fee"], "fee"), (1, 1, 0, ["fee", "adult"], "fee"), (1, 2, 0, ["child", "fee"], "fee"), (1, 2, 1, ["zoo"], "zoo"), (2, 3, 0, ["x", "fee"], "fee")]
    frame = spark.createDataFrame(rows, "session long, utterance long, ord int, terms array<string>, head string")
    got = {(r.session, r.utterance, r.ord): (r.operation, r.replaces) for r in needs.operations(frame).collect()}
    assert got == {(1, 0, 0): ("set", None), (1, 1, 0): ("repeat", 0), (1, 2, 0): ("update", 1), (1, 2, 1): ("set", None), (2, 3, 0): ("set", None)}


def test_asked_kinds_and_applicability(spark):
    from quarrymark.operators import needs

    texts = ["How much does it cost?", "how long does it take", "how many people", "which date works", "tell me about it", "How old must I be"]
    frame = spark.createDataFrame([(t,) for t in texts], ["t"])
    assert [r[0] for r in frame.select(needs.asked_kind(F.col("t"))).collect()] == ["amount", "duration", "count", "time", None, "age"]
    frame = spark.createDataFrame([("en",), ("de",), ("ALL",), (None,)], "v string")
    assert [r[0] for r in frame.select(needs.applicability(F.col("v"), F.lit("en"), "lang")).collect()] == ["kept", "not_applicable:lang", "kept", "kept"]
