"""Quality rules: one table of thresholds, compiled into one Spark projection.

Every metric is a column expression over the whole text, so nothing is shuffled and no user function runs.  A document is kept
when it passes the two base rules and every threshold of the table.

Defined cases: a null text has no words and fails; an empty text likewise; a null bound means "no bound"; a ratio whose
denominator is zero is null and passes (the length rules catch such texts).  Rows are independent, so repeated rows get equal
verdicts; other columns of the input are passed through untouched, also when they carry the name of a metric.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Very frequent function words of the four languages; the rule applies only to documents labelled with one of them.
STOP_WORDS = {
    "en": "the of and to in a is that for it with as on by be at this are was from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; a missing bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", 1.5, 30.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("mark_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.5),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def repeated_words(words: Column) -> Column:
    """Number of words inside ``WINDOW``-word windows that occur at least twice in the text, first occurrences included.

    Windows are compared by a 64-bit hash of their word hashes.  Only a text that has an equal pair sorts its windows; the
    positions of equal neighbours are then merged by one ordered pass, so the cost is n log n also for very long texts.
    """

    def grams(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, positions), total)

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            covered(windows)
        )

    long_enough = F.size(words) >= WINDOW
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(long_enough, let(let(hashed, grams), counted)).otherwise(F.lit(0).cast("long"))


def metrics(text: Column, lang: Column) -> Column:
    """One struct with every metric of a text."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, SPACE), "")
    dense = F.translate(whole, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(whole, "\n"), lambda s: s.rlike(WORD_CHARACTER))
    listed = F.coalesce(lang, F.lit(""))

    def is_stop(word: Column) -> Column:
        plain = F.lower(F.rtrim(word, F.lit(".,;:!?")))
        verdict = F.lit(False)
        for code, stop in STOP_WORDS.items():
            verdict = F.when(listed == code, plain.isin(*stop)).otherwise(verdict)
        return verdict

    def by_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n"),
            repeated_words(w).alias("repeated"),
            F.when(listed.isin(*STOP_WORDS), F.size(F.filter(w, is_stop))).alias("stop"),
        )

    def by_characters(d: Column) -> Column:
        return F.struct(
            F.char_length(d).cast("long").alias("n"),
            (F.char_length(d) - F.char_length(F.translate(d, SYMBOLS, ""))).cast("long").alias("symbols"),
            (F.char_length(d) - F.char_length(F.translate(d, "!?", ""))).cast("long").alias("marks"),
        )

    def by_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).cast("long").alias("n"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"),
            F.size(F.filter(ls, lambda s: s.rlike(r"^\s*[-*•]\s"))).alias("bullet"),
            F.size(F.filter(ls, lambda s: s.rlike(r"(\.\.\.|…)\s*$"))).alias("ellipsis"),
        )

    parts = F.struct(
        let(words, by_words).alias("w"), let(dense, by_characters).alias("c"), let(lines, by_lines).alias("l")
    )
    return let(
        parts,
        lambda p: F.struct(
            p["w"]["n"].alias("n_words"),
            p["c"]["n"].alias("word_chars"),
            p["c"]["symbols"].alias("n_symbols"),
            p["l"]["dup"].alias("n_dup_lines"),
            p["w"]["repeated"].alias("n_repeat_words"),
            _ratio(p["c"]["n"], p["w"]["n"]).alias("mean_word_length"),
            _ratio(p["c"]["symbols"], p["w"]["n"]).alias("symbol_ratio"),
            _ratio(p["c"]["marks"], p["w"]["n"]).alias("mark_ratio"),
            _ratio(p["w"]["stop"], p["w"]["n"]).alias("stop_word_ratio"),
            _ratio(p["l"]["dup"], p["l"]["n"]).alias("dup_line_ratio"),
            _ratio(p["l"]["bullet"], p["l"]["n"]).alias("bullet_line_ratio"),
            _ratio(p["l"]["ellipsis"], p["l"]["n"]).alias("ellipsis_line_ratio"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def passes(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one Boolean expression; an unknown metric (null) passes."""
    verdict = F.lit(True)
    for rule in rules:
        value = m[rule.metric]
        if rule.low is not None:
            verdict = verdict & F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            verdict = verdict & F.coalesce(value <= rule.high, F.lit(True))
    return verdict


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", lang: str = "lang") -> Column:
    """One struct for every row: all metrics, ``base_failed`` and ``kept``."""
    language = docs[lang] if lang in docs.columns else F.lit(None).cast("string")
    return let(
        metrics(docs[text], language),
        lambda m: F.struct(
            m.alias("metrics"),
            base_failed(m).alias("base_failed"),
            (~base_failed(m) & passes(m, rules)).alias("kept"),
        ),
    )


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document its id, all metrics and the verdict."""
    found = docs.select("doc_id", judged(docs, rules).alias("quality"))
    return found.select("doc_id", "quality.metrics.*", "quality.base_failed", "quality.kept")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Only the documents that pass, with the columns they came with."""
    return docs.where(judged(docs, rules)["kept"])
