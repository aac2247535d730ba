"""Personal data by anchor expansion.

An Aho-Corasick automaton reads each text once and reports anchors: at-signs, ``://``, plus signs before a digit, digits before a
dot, digits, and words that announce an account.  A deterministic parser then expands each anchor to the left and right, finds the
boundaries of the value and validates it.  Anchors inside a value that was already read are passed over, so a text is read once
and a long run of digits costs its length.

Kinds with a fixed grammar (base): email, ip, card, phone.  Added by the method: ``account``, a number that follows an announcing
word or an international account number with a right checksum; and ``login``, a user name and password inside a URL.

Defined cases: a null text is empty; a value that fails its check is dropped and not tried again from a later character; values
of different kinds may overlap; equal rows get equal results; rows are independent, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from quarrymark.llm.text_batches import checksum, each_block

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login")
SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, values array<string>"

DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ANNOUNCED = ("iban", "account no", "account number", "acct", "kontonummer", "numéro de compte", "número de cuenta")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+((?:\.[0-9]+){3})")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
INTERNATIONAL = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:[ \t]*(?:[:#.]|no\.?|nr\.?))*[ \t]*([0-9](?:[ -]?[0-9]){5,33})(?![0-9])", re.IGNORECASE)
LOGIN = re.compile(r"[^\s/?#:@\"'<>]+:[^\s/?#@\"'<>]+(?=@)")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors by the parser they start."""
    found = ahocorasick.Automaton()
    anchors: dict[str, set[str]] = {"@": {"email"}, "://": {"login"}}
    for d in DIGITS:
        anchors[d] = {"card"}
        anchors[f"{d}."] = {"ip"}
        anchors[f"+{d}"] = {"phone"}
    for cue in ANNOUNCED:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            anchors[form] = {"account"}
    for text, kinds in anchors.items():
        found.add_word(text, (len(text), tuple(kinds)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def international(text: str) -> bool:
    """The remainder-97 check of an international account number."""
    plain = text.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _email(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    left = at
    while left > done and text[left - 1] in LOCAL:
        left -= 1
    if left == at or (m := DOMAIN.match(text, at + 1)) is None:
        return None
    return left, m.end(), True


def _ip(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    left = at
    while left > done and text[left - 1] in DIGITS:
        left -= 1
    if (m := ADDRESS.match(text, left)) is None:
        return None
    return left, m.end(), all(len(v := p.lstrip("0")) <= 3 and int(v or "0") <= 255 for p in m[0].split("."))


def _card(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    if (m := CHAIN.match(text, at)) is None:
        return None
    digits = m[0].replace(" ", "").replace("-", "") if len(m[0]) < 64 else ""
    return at, m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    if (m := DIALLED.match(text, at)) is None:
        return None
    return at, m.end(), 8 <= sum(c in DIGITS for c in m[0]) <= 15


def _account(text: str, after: int) -> tuple[int, int, bool] | None:
    start = after
    while start < len(text) and text[start] in " \t:#.":
        start += 1
    if (m := INTERNATIONAL.match(text, start)) is not None and international(m[0]):
        return m.start(), m.end(), True
    if (m := ACCOUNT.match(text, after)) is not None:
        return m.start(1), m.end(1), True
    return None


def _login(text: str, after: int) -> tuple[int, int, bool] | None:
    m = LOGIN.match(text, after)
    return None if m is None else (m.start(), m.end(), True)


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans by kind in listed order, then by start; code points, end exclusive."""
    done = dict.fromkeys(KINDS, 0)
    spans: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    for last, (size, kinds) in automaton().iter(text):
        start = last - size + 1
        for kind in kinds:
            if start < done[kind]:
                continue
            if kind in PARSERS:
                value = PARSERS[kind](text, start, done[kind])
            else:
                value = (_account if kind == "account" else _login)(text, last + 1)
            if value is not None:
                left, right, valid = value
                done[kind] = right
                if valid:
                    spans[kind].append((kind, left, right))
    return [s for k in KINDS for s in spans[k]]


def _block(texts: list[str]) -> list[tuple]:
    out = []
    for text in texts:
        spans = find(text)
        base = [s for s in spans if s[0] in BASE]
        counts = [sum(s[0] == k for s in base) for k in BASE]
        digest = hashlib.sha256(checksum(base).encode()).hexdigest()
        out.append((*counts, digest, checksum(spans), [text[s:e] for _, s, e in spans]))
    return out


def found(docs: DataFrame) -> DataFrame:
    """Per document the counts, checksum, spans and the values themselves."""
    return each_block(docs, _block, SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    return found(docs).drop("values")
