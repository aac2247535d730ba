from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from corpus_cases import from_folder

from quarrymark.llm import pii_anchors as pii


def valid_card(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return 16 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0


GRAMMAR = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x[-4000:]) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", valid_card),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
}


def by_hand(text: str | None) -> list[tuple[str, int, int]]:
    return [(k, m.start(), m.end()) for k, (p, ok) in GRAMMAR.items() for m in re.finditer(p, text or "") if ok(m[0])]


def base(text: str) -> list[tuple[str, int, int]]:
    return [s for s in pii.find(text) if s[0] in pii.BASE]


def same(docs) -> None:
    want = Counter()
    for d in docs.collect():
        spans = by_hand(d["text"])
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        want[d["doc_id"], *(sum(s[0] == k for s in spans) for k in GRAMMAR), digest] += 1
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert Counter(tuple(r) for r in pii.digests(docs).select(columns).collect()) == want


def test_documents(spark):
    same(from_folder(spark, "documents"))


def test_awkward(awkward, nothing):
    same(awkward)
    assert pii.digests(nothing).count() == 0


def test_random_texts():
    rng = random.Random(7)
    extra = ["4111 1111 1111 1111", "a@b.co@d.ef", "1.2.3.4.5", "+49 (30) 123-456", "0000001.2.3.004", "a+1@b.c"]
    for _ in range(20000):
        text = "".join(rng.choice("0123456.@+- ()aZ-%é") for _ in range(rng.randint(0, 40)))
        text += rng.choice(["", "", " "]) + rng.choice(extra) if rng.random() < 0.4 else ""
        assert base(text) == by_hand(text), text


@pytest.mark.parametrize("text", ["1" * 60000, "1." * 30000, "a@" * 30000, "+1" * 30000, "0" * 5000 + ".0.0.1", "1-" * 30000, "://a:" * 9000])
def test_long_runs(text):
    assert base(text) == by_hand(text) if len(text) < 20000 else isinstance(pii.find(text), list)


def test_added_kinds():
    text = "Account no: 12345678; IBAN DE89 3704 0044 0532 0130 00, IBAN DE88 3704 ftp://bob:pw@h/x http://h/a:b@c"
    kinds = [(k, text[s:e]) for k, s, e in pii.find(text) if k not in pii.BASE]
    assert ("account", "12345678") in kinds and ("account", "DE89 3704 0044 0532 0130 00") in kinds
    assert [v for k, v in kinds if k == "login"] == ["bob:pw"]


def test_offsets_are_code_points():
    text = "\U0001f600 é a@b.co"
    assert pii.find(text) == [("email", 4, 10)]
