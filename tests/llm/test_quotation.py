from __future__ import annotations

from collections import Counter

from corpus_cases import from_folder

from quarrymark.llm import quotation

SCHEMA = "conv_id long, turn long, role string, text string, position string, mid string, root string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "p", "m", "r") for r in rows], SCHEMA)


def test_replies_nested_quotes_and_order(spark):
    rows = [
        (1, 0, "a", "Hello there.\nHow are you?"),
        (1, 1, "b", "> Hello   THERE\nFine.\nThanks"),
        (1, 2, "a", "New topic"),
        (1, 3, "b", ">> Hello there.\n> Fine.\nGood"),
        (1, 4, "a", "> new TOPIC!\n> never said\nok"),
        (2, 0, "a", "> New topic\nelsewhere"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotation.conversations_in_reply_order(talk(spark, rows)).collect()}
    assert [got[1, t]["parent_turn"] for t in range(5)] == [None, 0, None, 1, 2]
    assert [got[1, t]["root_turn"] for t in range(5)] == [0, 0, 2, 0, 2]
    assert [got[1, t]["position"] for t in (0, 1, 3, 2, 4)] == [1, 2, 3, 4, 5]
    assert got[1, 3]["text"] == "Good" and got[1, 3]["n_quoted"] == 2 and got[1, 3]["n_linked"] == 2
    assert got[1, 4]["n_linked"] == 1 and got[2, 0]["parent_turn"] is None and got[2, 0]["text"] == "elsewhere"


def test_a_chain_of_fifty_replies(spark):
    rows = [(1, 0, "a", "line 0")] + [(1, i, "a", f"> line {i - 1}\nline {i}") for i in range(1, 50)]
    got = quotation.conversations_in_reply_order(talk(spark, rows)).collect()
    assert {r["root_turn"] for r in got} == {0} and [r["parent_turn"] for r in sorted(got, key=lambda r: r["turn"])][1:] == list(range(49))


def test_nulls_repeats_and_ties(spark):
    rows = [
        (None, 0, "a", "x said"),
        (None, 1, None, "> x said\ny"),
        (2, None, None, None),
        (2, 0, "a", ""),
        (2, 0, "a", ""),
        (2, 0, "a", "> "),
        (None, None, None, None),
    ]
    got = quotation.conversations_in_reply_order(talk(spark, rows)).collect()
    assert Counter((r["conv_id"], r["turn"]) for r in got) == Counter(r[:2] for r in rows)
    for conv in (None, 2):
        places = sorted(r["position"] for r in got if r["conv_id"] == conv)
        assert places == list(range(1, len(places) + 1))
    assert next(r for r in got if r["turn"] == 1)["parent_turn"] == 0
    assert quotation.conversations_in_reply_order(talk(spark, rows).where("false")).count() == 0


def test_a_common_passage_makes_no_pairs(spark):
    rows = [(1, i, "a", "yes\n> yes" if i else "yes") for i in range(300)]
    parsed = quotation.parsed(talk(spark, rows))
    assert quotation.links(parsed).count() == 299


def test_conversations_without_quotes_keep_their_text(spark):
    table = from_folder(spark, "conversations")
    got = quotation.conversations_in_reply_order(table).collect()
    want = {(r["conv_id"], r["turn"]): r["text"] for r in table.collect()}
    assert len(got) == len(want)
    for r in got:
        assert r["text"] == want[r["conv_id"], r["turn"]].strip(" \t\n") and r["parent_turn"] is None
        assert r["position"] == r["turn"] + 1


def ordered(spark, texts: list[str]) -> list:
    rows = [(1, i, "abc"[i % 3], t) for i, t in enumerate(texts)]
    return sorted(quotation.conversations_in_reply_order(talk(spark, rows)).collect(), key=lambda r: r["turn"])


def test_a_greeting_links_to_its_latest_sayer(spark):
    got = ordered(spark, ["Hello all,\nfirst topic", "Hello all,\nsecond topic", "> Hello all,\nyes"])
    assert got[2]["parent_turn"] == 1


def test_passages_wrapped_at_another_width(spark):
    text = "The plan holds for the whole\nyear and nobody has to pay\nmore. Ask before May."
    got = ordered(spark, ["Something else. And more.", text, "> The plan holds\n> for the whole year and\n> nobody has to pay more. Ask\n> before May.\nFine",
                          "> nobody said this.\n> Ask before\n> May.\nWhen?"])
    assert [r["parent_turn"] for r in got] == [None, None, 1, 1] and got[3]["n_linked"] == 1


def test_lines_link_only_when_one_message_has_said_them(spark):
    got = ordered(spark, ["Yes\nred", "Yes\nblue", "> Yes\n> or no\nwhat?", "> blue\n> or no\nwhat?"])
    assert got[2]["parent_turn"] is None and got[3]["parent_turn"] == 1


def test_a_paragraph_of_a_longer_message(spark):
    got = ordered(spark, ["Intro here.\n\nThe middle one\nis long.\n\nEnd.", "> The middle\n> one is long.\n>\n> Unknown words\nok"])
    assert got[1]["parent_turn"] == 0 and got[1]["n_linked"] == 1 and got[1]["text"] == "ok"


def test_announcing_lines_go(spark):
    got = ordered(spark, ["First words.", "On Monday b wrote:\n> First words.\nI agree.", "Am Dienstag schrieb b:\n\n> On Monday b wrote:\n>> First words.\n> I agree.\nMe too. He wrote:\nnothing"])
    assert got[1]["text"] == "I agree." and got[1]["parent_turn"] == 0
    assert got[2]["parent_turn"] == 1 and got[2]["text"].endswith("He wrote:\nnothing")


def test_a_long_thread_is_numbered_in_turn_ranges(spark, monkeypatch):
    monkeypatch.setattr(quotation, "TURN_RANGE", 16)
    rows = [(1, 0, "a", "line 0")] + [(1, i, "a", f"> line {i - 1 if i % 3 else 0}\nline {i}") for i in range(1, 200)] + [(1, 5, "z", "alone")]
    got = quotation.conversations_in_reply_order(talk(spark, rows)).collect()
    thread = sorted((r for r in got if r["role"] == "a"), key=lambda r: r["position"])
    assert [r["turn"] for r in thread] == list(range(200)) and {r["root_turn"] for r in thread} == {0}
    assert sorted(r["position"] for r in got) == list(range(1, 202))


def test_very_long_texts_and_other_columns(spark):
    long = " ".join(f"w{i}" for i in range(40_000)) + "."
    lines = "\n".join(f"l{i}" for i in range(20_000))
    got = ordered(spark, [long, "> " + long + "\nok", lines, "\n".join("> " + x for x in lines.split("\n"))])
    assert [r["parent_turn"] for r in got] == [None, 0, None, 2] and got[3]["n_quoted"] == 20_000


def test_native_plan(spark):
    frame = quotation.links(quotation.parsed(from_folder(spark, "conversations")))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_sql_agrees_on_quotes(spark):
    import random

    import compare
    import duckdb

    from quarrymark.llm import queries

    rng = random.Random(6)
    lines = [f"Line {i}, said once" for i in range(12)]
    rows = []
    for conv in range(6):
        for turn in range(25):
            text = "\n".join(rng.choice(["", "> ", ">> ", "", " > > ", "> "]) + rng.choice([*lines, "b wrote:", ""]) for _ in range(rng.randint(0, 7)))
            rows.append((conv, turn, "u", text))
    frame = talk(spark, rows)
    got = quotation.conversations_in_reply_order(frame)
    con = duckdb.connect()
    con.register("conversations", frame.select("conv_id", "turn", "role", "text").toPandas())
    rel = con.sql(queries.SQL["op5_quotation_linking"])
    mine = [tuple(r) for r in got.collect()]
    assert any(r.n_linked for r in got.collect())
    assert compare.canonical(got.columns, mine) == compare.canonical(rel.columns, [tuple(None if x != x else x for x in r) for r in rel.fetchall()])
