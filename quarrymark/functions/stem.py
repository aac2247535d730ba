"""Text functions without a built-in counterpart: English suffix stripping (the published Porter2 rules) and NFKC folding."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Exceptional forms of the published algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEEP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Suffix tables of steps 2 to 4, longest first where they overlap.
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
)
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
        return m.end() if m else len(word)

    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(prefix) if prefix else after(0)
    return r1, after(r1)


def _short(word: str, r1: int) -> bool:
    ends = re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word)
    return bool(ends) and r1 >= len(word)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(r"(^|[aeiouy])y", lambda m: m.group(1) + "Y", word)
    r1, r2 = _regions(w.lower().replace("Y", "y") if "Y" not in w else re.sub("Y", "0", w))
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEEP_AFTER_1A:
        return w.lower()
    # step 1b
    if w.endswith(("eed", "eedly")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        suffix = next((s for s in ("ingly", "edly", "ing", "ed") if w.endswith(s)), None)
        if suffix and re.search(r"[aeiouy]", w[: -len(suffix)]):
            w = w[: -len(suffix)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif _short(w, r1):
                w += "e"
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # step 2
    for suffix, repl in STEP2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + repl
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in "cdeghkmnrt":
            w = w[:-2]
    # step 3
    for suffix, repl in STEP3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + repl
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # step 4
    suffix = next((s for s in STEP4 if w.endswith(s)), None)
    if suffix:
        if len(w) - len(suffix) >= r2:
            w = w[: -len(suffix)]
    elif w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        w = w[:-3]
    # step 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1], 0)):
            keep = len(w) - 1 < r2 and re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w[:-1])
            w = w if keep else w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility folding (full-width digits, ligatures); ASCII text needs none."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_terms(tokens: pa.Array) -> pa.Array:
    """Every distinct term of a batch is stemmed once."""
    coded = pc.dictionary_encode(tokens.flatten())
    stems = pa.array([None if t is None else stem(t) for t in coded.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(tokens), 0)
    offsets = pa.array([0, *pc.cumulative_sum(sizes).to_pylist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=tokens.is_null() if tokens.null_count else None)
