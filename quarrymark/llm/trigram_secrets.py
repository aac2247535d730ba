"""Secret scans with a trigram inverted index.

Each rule's regular expression yields a Boolean query over the trigrams that every match must contain.  A block of documents is
indexed as posting lists, trigram -> documents, for the trigrams that the rule set names (no query ever reads another list).  Queries
are answered by intersecting and uniting postings, and only the documents that remain are verified with the expression itself.  A
rule without mandatory trigrams, such as long hexadecimal runs, scans every document.

The index is partitioned by document: blocks of bounded size are indexed and searched where their texts are, so nothing is shuffled
and a common trigram's list never outgrows its block.

Kinds: assign, access, hex (base); private_key, code_host, chat, cloud and web_token are added.  Defined cases: a null text is
empty; a match that fails its check is dropped and not tried again from a later character; spans of different kinds may overlap;
equal rows get equal results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymark.llm.text_batches import checksum
from quarrymark.llm.trigram_queries import ANYTHING, Query, derive
from quarrymark.llm.word_hashes import raw, slices

BLOCK_BYTES = 4 << 20
SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "secrets array<string>, n_verified long"
)


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: re.Pattern
    valid: Callable[[re.Match], bool] = lambda m: True


RULES = (
    SecretRule(
        "assign",
        re.compile(
            r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
        ),
        lambda m: len(m[2]) >= 6,
    ),
    SecretRule("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    SecretRule("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    SecretRule("private_key", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")),
    SecretRule("code_host", re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}")),
    SecretRule("chat", re.compile(r"xox[abeprs]-[A-Za-z0-9-]{10,}")),
    SecretRule("cloud", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    SecretRule("web_token", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
)
BASE = 3

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@lru_cache(maxsize=1)
def plan() -> tuple[tuple[Query, ...], np.ndarray]:
    """The rules' queries, and for each of the 2 ** 24 trigrams whether a query reads its list."""
    queries = tuple(derive(r.pattern) for r in RULES)
    wanted = np.zeros(1 << 24, dtype=bool)
    for q in queries:
        for t in q.trigrams():
            wanted[int.from_bytes(t, "big")] = True
    return queries, wanted


class Postings:
    """Inverted index of one block: for each wanted trigram the sorted numbers of the documents that hold it."""

    def __init__(self, data: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> None:
        low = LOWER[data[at[0] : at[-1]]].astype(np.uint32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        place = np.flatnonzero(wanted[codes])
        ends = at[1:] - at[0]
        doc = np.searchsorted(ends, place, side="right")
        whole = place + 3 <= ends[np.minimum(doc, len(ends) - 1)]  # not across two documents
        pairs = np.unique((codes[place[whole]].astype(np.int64) << 32) | doc[whole])
        trigram, first = np.unique(pairs >> 32, return_index=True)
        self.lists = dict(zip(trigram.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:]), strict=True)) if len(pairs) else {}

    def answer(self, part: Query | bytes) -> np.ndarray:
        if isinstance(part, bytes):
            return self.lists.get(int.from_bytes(part, "big"), np.zeros(0, np.int64))
        found = [self.answer(p) for p in part.parts]
        if part.kind == "any":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        result = found[0]
        for other in found[1:]:
            result = np.intersect1d(result, other, assume_unique=True)
        return result


def verified(rule: SecretRule, number: int, text: str) -> Iterator[tuple[int, int, int]]:
    for m in rule.pattern.finditer(text):
        if rule.valid(m):
            yield m.start(), number, m.end()


def _scan(column: pa.Array, data: np.ndarray, at: np.ndarray, lo: int, hi: int) -> list[tuple]:
    queries, wanted = plan()
    postings = Postings(data, at[lo : hi + 1], wanted)
    texts = column.slice(lo, hi - lo).to_pylist()
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    checks = np.zeros(len(texts), dtype=np.int64)
    for number, (rule, query) in enumerate(zip(RULES, queries, strict=True)):
        candidates = range(len(texts)) if query == ANYTHING else postings.answer(query).tolist()
        for i in candidates:
            checks[i] += 1
            spans[i] += verified(rule, number, texts[i])
    out = []
    for text, found, n in zip(texts, spans, checks.tolist(), strict=True):
        named = [(RULES[k].kind, s, e) for s, k, e in sorted(found)]
        base = [(RULES[k].kind, s, e) for s, k, e in sorted(found) if k < BASE]
        counts = [sum(k == number for _, k, _ in found) for number in range(BASE)]
        digest = hashlib.sha256(checksum(base).encode()).hexdigest()
        out.append((*counts, digest, checksum(named), [text[s:e] for _, s, e in named], n))
    return out


_ARROW = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()]
_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets", "n_verified"]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        data, at = raw(column)
        for lo, hi in slices(at, BLOCK_BYTES):
            found = zip(*_scan(column, data, at, lo, hi), strict=True)
            columns = [pa.array(c, t) for c, t in zip(found, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=_NAMES)


def found(docs: DataFrame) -> DataFrame:
    """Per document the counts, checksum, spans, the secrets and how many rules had to be verified on it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(_scanned, SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    return found(docs).drop("secrets", "n_verified")
