from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from corpus_cases import from_folder

from quarrymark.llm import turn_repair as repair
from quarrymark.llm.turn_edits import Repair, Steps

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?\Z")
ROWS = "conv_id long, turn long, role string, text string"


def cheapest(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, list[tuple[str, str]]]:
    """All edit strings in order of (cost, string), by brute force over whole strings."""
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, roles, out = heapq.heappop(queue)
        if at == len(rows) and LEGAL.match(roles):
            return cost, audit, list(out)
        if len(audit) - at <= 3:
            for name in ("user", "assistant"):
                if LEGAL.match(roles + name[0]) or LEGAL.match(roles + name[0] + "a") or LEGAL.match(roles + name[0] + "ua"):
                    heapq.heappush(queue, (cost + 5, audit + "I", at, roles + name[0], (*out, (name, ""))))
        if at < len(rows):
            role, text, unwanted, cut = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, roles, out))
            if not unwanted:
                for edit, name in (("K", role), ("R", "user"), ("R", "assistant")):
                    now = roles + (name[:1] or "?")
                    if any(LEGAL.match(now + tail) for tail in ("", "a", "ua")):
                        price = cost + (edit == "R") + 5 * cut
                        heapq.heappush(queue, (price, audit + edit, at + 1, now, (*out, (name, text))))
    raise AssertionError


def faults(rows: list[tuple]) -> tuple[list[tuple], int, int, int, int, int]:
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, judged, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        visible = VISIBLE.findall(text)
        kind = 0 if not visible else 1 if (role, text) in seen else 2 if visible[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            counts[kind] += 1
        judged.append((role, text, kind in (0, 1), kind == 2))
    pairs = zip(judged, judged[1:], strict=False)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return judged, gaps, *counts, illegal


def by_hand(rows: list[tuple], damage: bool) -> dict:
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv].extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    found = {}
    for conv, members in groups.items():
        judged, *counts = faults(members)
        cost, audit, out = cheapest(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv] = (*counts, cost, audit, digest)
    return found


def as_dict(df) -> dict:
    rows = df.collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_against_all_edit_strings(spark):
    rows = from_folder(spark, "conversations")
    expected = by_hand([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()], True)
    assert as_dict(repair.digests(rows)) == expected


AWKWARD = [
    (1, None, "user", "No turn."),
    (1, None, None, None),
    (1, 5, "user", "Hello there."),
    (1, 5, "user", "Hello there."),
    (1, 9, "assistant", "tail without a stop"),
    (None, 1, "system", "Rules."),
    (None, 2, "system", "More rules."),
    (2, 1, "", "No role."),
    (2, 2, "assistant", " \t\n\x0b\x0c\r"),
    (2, 3, "tool", "Result!"),
    (3, 1, "user", "x" * 200000 + "?"),
    (3, 1, "assistant", "Ünïcödé 日本語 \U0001f600."),
    (4, -(2**62), "user", "Far."),
    (4, 2**62, "assistant", "Away."),
    (5, 1, "", ""),
    (6, 3, "assistant", "One."),
    (6, 1, "assistant", "Two."),
    (6, 2, "assistant", "One."),
]


@pytest.mark.parametrize("damage", [True, False])
def test_awkward(spark, damage):
    rows = spark.createDataFrame([(*r, "clash") for r in AWKWARD], ROWS + ", audit string")
    got = as_dict(repair.digests(rows) if damage else repair.report(rows))
    assert got == by_hand(AWKWARD, damage)


def test_empty_and_dropped(spark):
    assert repair.digests(spark.createDataFrame([], ROWS)).count() == 0
    gone = [(0, t, "user", "Gone.") for t in range(200) if zlib.crc32(f"0:{t}".encode()) % 20 == 0][:2]
    row = repair.digests(spark.createDataFrame(gone, ROWS)).first()
    assert tuple(row) == (0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_other_key_type(spark):
    rows = spark.createDataFrame([("a", 1, "user", "Hi."), (None, 1, "user", "Hi.")], ROWS.replace("conv_id long", "conv_id string"))
    assert {r["conv_id"]: r["audit"] for r in repair.report(rows).collect()} == {"a": "D", None: "D"}


def test_random_rows_against_all_edit_strings():
    draw = random.Random(5)
    steps = Steps()
    for _ in range(400):
        rows = [
            (draw.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), f"t{i}", draw.random() < 0.2, draw.random() < 0.2)
            for i in range(draw.randrange(7))
        ]
        rows = [(r, t, u, c and not u) for r, t, u, c in rows]
        one = Repair(steps, "/nowhere")
        for row in rows:
            one.add(*row)
        cost, audit, out = cheapest(rows)
        assert one.result() == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def test_spilled_pointers_and_their_removal(tmp_path):
    draw = random.Random(6)
    rows = [(draw.choice(["system", "user", "assistant"]), f"t{i}", draw.random() < 0.1, draw.random() < 0.1) for i in range(5000)]
    whole, spilled = Repair(Steps(), "/nowhere"), Repair(Steps(), str(tmp_path), 64)
    for row in rows:
        whole.add(*row)
        spilled.add(*row)
    assert len(list(tmp_path.iterdir())) == 5000 // 64
    assert whole.result() == spilled.result()
    assert not list(tmp_path.iterdir())


def test_batches_of_one_row_give_the_same(spark):
    rows = from_folder(spark, "conversations")
    expected = as_dict(repair.digests(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert as_dict(repair.digests(rows)) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_rows(spark):
    rows = repair.damaged(from_folder(spark, "conversations"))
    expected = {c: v[-1] for c, v in as_dict(repair.report(rows)).items()}
    out = defaultdict(list)
    for r in repair.repaired(rows).orderBy("conv_id", "position").collect():
        out[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    empty = hashlib.sha256().hexdigest()
    assert {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in out.items()} == {
        c: h for c, h in expected.items() if h != empty
    }
