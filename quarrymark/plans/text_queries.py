"""Text functions over the documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymark.functions import text as tx
from quarrymark.functions import values as vx
from quarrymark.functions.stem import nfkc, stem_terms
from quarrymark.operators.corpus import basic_normalise
from quarrymark.plans.corpus_queries import texts
from quarrymark.plans.registry import named
from quarrymark.plans.sql_parts import sql_terms


def _rx(pattern: str) -> str:
    return pattern.replace("'", "''")


_R = tx.REDACTIONS
_SPLIT = "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s)), lambda s: length(s) > 0)"


def turns(t):
    return t.conversations.select("conv_id", "turn", "role", "text")


@named("redact_pii")
def redact_pii(t):
    """Look-arounds have no SQL counterpart here; the test suite checks this one against hand-made rows."""
    clean, n = tx.redact(F.col("text"))
    return texts(t).select("doc_id", F.sha1(clean).alias("digest"), n.alias("n_redactions"))


@named(
    "redact_simple",
    "SELECT doc_id, sha1(regexp_replace(regexp_replace(text, '" + _rx(_R[0][1]) + "', '[EMAIL]', 'g'), '" + _rx(_R[1][1]) + "', '[SECRET]', 'g')) AS digest, "
    "len(regexp_extract_all(text, '" + _rx(_R[0][1]) + "')) AS n_email FROM documents",
)
def redact_simple(t):
    """The first two redaction kinds alone (they need no look-around)."""
    text = F.col("text")
    out = F.regexp_replace(F.regexp_replace(text, _R[0][1], "[EMAIL]"), _R[1][1], "[SECRET]")
    return texts(t).select("doc_id", F.sha1(out).alias("digest"), F.regexp_count(text, F.lit(_R[0][1])).alias("n_email"))


@named(
    "typed_values",
    "SELECT doc_id, array_to_string(list_transform(list_distinct_ordered, lambda x: x), ';') AS vals FROM (SELECT doc_id, list_filter(ns, lambda x, i: list_position(ns, x) = i) AS list_distinct_ordered FROM "
    "(SELECT doc_id, list_transform(regexp_extract_all(text, '" + _rx(vx.COUNT) + "', 1), lambda n: regexp_replace(replace(n, ',', '.'), '\\.0$', '')) AS ns FROM documents)) WHERE len(list_distinct_ordered) > 0",
)
def typed_values(t):
    rows = texts(t).select("doc_id", vx.typed_values(F.col("text"), "count").alias("v"))
    return rows.where(F.size("v") > 0).select("doc_id", F.array_join("v", ";").alias("vals"))


def _sql_either(rx: str, a: int, b: int) -> str:
    return (
        f"list_transform(list_zip(regexp_extract_all(text, '{_rx(rx)}', {a}), regexp_extract_all(text, '{_rx(rx)}', {b})), "
        "lambda z: CASE WHEN coalesce(z[1], '') <> '' THEN z[1] ELSE z[2] END)"
    )


@named(
    "typed_values_by_kind",
    "WITH v AS (SELECT doc_id, 'amount' AS kind, unnest(list_transform(" + _sql_either(vx.AMOUNT, 1, 2) + ", lambda n: regexp_replace(replace(n, ',', '.'), '\\.0$', '') || ' cur')) AS v FROM documents "
    "UNION ALL SELECT doc_id, 'age', unnest(list_transform(" + _sql_either(vx.AGE, 1, 2) + ", lambda n: regexp_replace(replace(n, ',', '.'), '\\.0$', '') || ' y')) FROM documents "
    "UNION ALL SELECT doc_id, 'duration', unnest(list_transform(list_zip(regexp_extract_all(text, '" + _rx(vx.DURATION) + "', 1), regexp_extract_all(text, '" + _rx(vx.DURATION) + "', 2)), lambda z: regexp_replace(replace(z[1], ',', '.'), '\\.0$', '') || ' ' || rtrim(lower(z[2]), 's'))) FROM documents "
    "UNION ALL SELECT doc_id, 'measure', unnest(list_transform(list_zip(regexp_extract_all(text, '" + _rx(vx.MEASURE) + "', 1), regexp_extract_all(text, '" + _rx(vx.MEASURE) + "', 2)), lambda z: regexp_replace(replace(z[1], ',', '.'), '\\.0$', '') || ' ' || left(lower(z[2]), 2))) FROM documents) "
    "SELECT doc_id, kind, v AS value, count(*) > 0 AS present FROM v GROUP BY doc_id, kind, v",
)
def typed_values_by_kind(t):
    kinds = ("amount", "age", "duration", "measure")

    def tagged(kind: str):
        return F.transform(
            vx.typed_values(F.col("text"), kind), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
        )

    each = F.flatten(F.array(*[tagged(k) for k in kinds]))
    return texts(t).select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.kind", "x.value", F.lit(True).alias("present"))


@named(
    "value_presence",
    # word boundaries are ASCII-only in this dialect: accented letters become a plain letter no pattern uses
    "SELECT doc_id, "
    + ", ".join(f"regexp_matches(regexp_replace(text, '[À-ÖØ-öø-ſ]', 'q', 'g'), '{_rx(rx)}') AS has_{k}" for k, rx in vx.PRESENCE.items())
    + " FROM documents",
)
def value_presence(t):
    return texts(t).select("doc_id", *[vx.has_value(F.col("text"), k).alias(f"has_{k}") for k in vx.PRESENCE])


@named(
    "numbers_in_text",
    "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*'))), ';') AS numbers FROM documents WHERE regexp_matches(text, '\\d')",
)
def numbers_in_text(t):
    rows = texts(t).where(F.col("text").rlike(r"\d"))
    return rows.select("doc_id", F.array_join(tx.number_tokens(F.col("text")), ";").alias("numbers"))


@named("number_values")
def number_values(t):
    """Canonical values, digits and words alike (the digit rule needs look-behind; checked in the tests)."""
    rows = texts(t).select("doc_id", tx.numbers_in(F.col("text")).alias("v"))
    return rows.where(F.size("v") > 0).select("doc_id", F.array_join("v", ";").alias("vals"))


@named(
    "negation_flags",
    "SELECT conv_id, turn, regexp_matches(lower(text), '\\b(?:" + "|".join(tx.POLARITY_WORDS) + ")\\b|n''t\\b') AS negated, "
    "array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\\b(?:" + "|".join(tx.GUARD_NEGATIONS) + ")\\b|n''t\\b'))), ',') AS cues FROM conversations",
)
def negation_flags(t):
    return turns(t).select(
        "conv_id",
        "turn",
        tx.is_negated(F.col("text")).alias("negated"),
        F.array_join(tx.guard_negations(F.col("text")), ",").alias("cues"),
    )


@named(
    "injection_filter",
    "SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE regexp_matches(s, '" + _rx(tx.INSTRUCTION) + "')) AS n_excluded FROM "
    f"(SELECT doc_id, unnest({_SPLIT}) AS s FROM documents) GROUP BY doc_id",
)
def injection_filter(t):
    rows = texts(t).select("doc_id", tx.sentences(F.col("text")).alias("ss")).where(F.size("ss") > 0)
    return rows.select(
        "doc_id",
        F.size("ss").alias("n_sentences"),
        F.size(F.filter("ss", lambda s: tx.is_instruction(s))).alias("n_excluded"),
    )


@named(
    "acronym_mine",
    "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '((?:\\p{L}+[ -]){1,7}\\p{L}+) \\((\\p{Lu}{2,8})\\)', 1)) AS l, unnest(regexp_extract_all(text, '((?:\\p{L}+[ -]){1,7}\\p{L}+) \\((\\p{Lu}{2,8})\\)', 2)) AS s FROM documents), "
    "w AS (SELECT doc_id, s, list_filter(regexp_split_to_array(l, '[ -]'), lambda x: lower(x) NOT IN ('a','an','and','for','in','of','on','the','to')) AS ws FROM m), "
    "k AS (SELECT doc_id, s, ws[greatest(len(ws) - length(s) + 1, 1):] AS tail FROM w) "
    "SELECT doc_id, s AS short, array_to_string(tail, ' ') AS long FROM k WHERE upper(array_to_string(list_transform(tail, lambda x: left(x, 1)), '')) = s",
)
def acronym_mine(t):
    rows = texts(t).select("doc_id", F.explode(tx.acronyms(F.col("text"))).alias("a"))
    return rows.select("doc_id", "a.short", "a.long")


@named(
    "fixed_pairs",
    "SELECT p[1] || ' and ' || p[2] AS pair, count(*) AS n FROM (SELECT unnest(list_zip(regexp_extract_all(lower(text), '(\\p{L}+) (?:and|&) (\\p{L}+)', 1), regexp_extract_all(lower(text), '(\\p{L}+) (?:and|&) (\\p{L}+)', 2))) AS p FROM documents) GROUP BY ALL",
)
def fixed_pairs(t):
    """Coordinations with the number of times they are said; a request must not be split inside a frequent one."""
    rx = F.lit(r"(\p{L}+) (?:and|&) (\p{L}+)")
    low = F.lower("text")
    pairs = F.zip_with(
        F.regexp_extract_all(low, rx, 1), F.regexp_extract_all(low, rx, 2), lambda a, b: F.concat_ws(" and ", a, b)
    )
    return texts(t).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@named(
    "temporal_cues",
    "SELECT doc_id, CASE WHEN try_cast(nullif(regexp_extract(text, '\\b(\\d{4}-\\d{2}-\\d{2})\\b', 1), '') AS DATE) IS NOT NULL THEN 'date' "
    "WHEN regexp_matches(lower(text), '\\b(" + "|".join(vx.MONTHS) + ") (\\d{4})\\b') THEN 'month' WHEN regexp_matches(lower(text), '\\b((?:19|20)\\d{2})\\b') THEN 'year' "
    "WHEN regexp_matches(lower(text), '\\b(?:currently|now|today|at present|nowadays)\\b') THEN 'current' WHEN regexp_matches(lower(text), '\\b(?:previously|formerly|used to|in the past|before)\\b') THEN 'past' ELSE 'none' END AS kind, "
    "CASE WHEN try_cast(nullif(regexp_extract(text, '\\b(\\d{4}-\\d{2}-\\d{2})\\b', 1), '') AS DATE) IS NULL AND NOT regexp_matches(lower(text), '\\b(" + "|".join(vx.MONTHS) + ") (\\d{4})\\b') AND regexp_matches(lower(text), '\\b((?:19|20)\\d{2})\\b') "
    "THEN regexp_extract(lower(text), '\\b((?:19|20)\\d{2})\\b', 1) || '-12-31' END AS year_end FROM documents",
)
def temporal_cues(t):
    rows = texts(t).select("doc_id", vx.temporal_cue(F.col("text")).alias("c"))
    return rows.select("doc_id", "c.kind", F.when(F.col("c.kind") == "year", F.col("c.valid_to")).alias("year_end"))


@named(
    "query_normalise",
    "SELECT conv_id, turn, sha1(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[\\s.?!,;:]+$', '')) AS digest FROM conversations",
)
def query_normalise(t):
    return turns(t).select("conv_id", "turn", F.sha1(tx.normalise_query(F.col("text"))).alias("digest"))


@named(
    "json_payload",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS canonical FROM events",
)
def json_payload(t):
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.to_json(F.struct("event_type", "user_id")).alias("canonical"),
    )


@named(
    "text_hashes",
    "SELECT doc_id, sha1(text) AS sha1_hex, sha256(text) AS sha256_hex, md5(text) AS md5_hex FROM documents",
)
def text_hashes(t):
    return t.documents.select(
        "doc_id", F.sha1("text").alias("sha1_hex"), F.sha2("text", 256).alias("sha256_hex"), F.md5("text").alias("md5_hex")
    )


@named(
    "set_similarity",
    f"WITH p AS (SELECT conv_id, turn, list_distinct({sql_terms('text')}) AS b, lag(list_distinct({sql_terms('text')})) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) "
    "SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard, "
    "round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS containment, round(2 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 6) AS f1 FROM p WHERE a IS NOT NULL",
)
def set_similarity(t):
    """Every turn against the turn before it."""
    from quarrymark.functions import sets
    from quarrymark.operators.ordered import Split

    rows = t.conversations.select("conv_id", "turn", tx.terms(F.col("text")).alias("b"))
    pairs = Split(["conv_id"], ["turn"], F.floor(F.col("turn") / 64)).lag(rows, a="b").where("a IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        "conv_id",
        "turn",
        F.round(sets.jaccard(a, b), 6).alias("jaccard"),
        F.round(sets.containment(a, b), 6).alias("containment"),
        F.round(sets.term_f1(a, b), 6).alias("f1"),
    )


@named("analyser_full")
def analyser_full(t):
    """The full analyser: compatibility folding, number words to digits, stop words out, English stems."""
    folded = texts(t).select("doc_id", nfkc("text").alias("text"))
    tokens = tx.drop_stopwords(tx.spoken_numbers(tx.raw_tokens(basic_normalise(F.col("text")))))
    rows = folded.select("doc_id", tokens.alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("n"), F.sha1(F.array_join(stem_terms("tokens"), " ")).alias("digest"))


_SPAN_WORD = "[A-Za-z0-9]+(?:[''’\\-][A-Za-z0-9]+)*"


@named(
    "span_words",
    f"WITH l AS (SELECT conv_id, turn, unnest(list_zip(range(0, len(ws)), ws, gaps[1:len(ws)])) AS z FROM (SELECT conv_id, turn, regexp_extract_all(text, '{_SPAN_WORD}') AS ws, string_split_regex(text, '{_SPAN_WORD}') AS gaps FROM conversations)), "
    "p AS (SELECT conv_id, turn, z[1] AS pos, z[2] AS word, sum(length(z[3]) + length(z[2])) OVER (PARTITION BY conv_id, turn ORDER BY z[1]) AS stop FROM l) "
    "SELECT conv_id, turn, pos, lower(word) AS word, CAST(stop - length(word) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p",
)
def span_words(t):
    """Every word of an utterance with its place: the text between two words is what splitting at the words leaves."""
    rx = F.lit(r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*")
    pieces = F.arrays_zip(F.regexp_extract_all("text", rx, 0).alias("word"), F.split("text", rx.cast("string")).alias("gap"))
    rows = turns(t).select("conv_id", "turn", F.posexplode(pieces).alias("pos", "p")).where("p.word IS NOT NULL")
    upto = Window.partitionBy("conv_id", "turn").orderBy("pos")  # one utterance
    stop = F.sum(F.length("p.gap") + F.length("p.word")).over(upto)
    return rows.select("conv_id", "turn", "pos", F.col("p.word").alias("raw"), stop.alias("stop")).select(
        "conv_id", "turn", "pos", F.lower("raw").alias("word"), (F.col("stop") - F.length("raw")).alias("start"), "stop"
    )


@named(
    "counted_nouns",
    f"SELECT doc_id, len(regexp_extract_all(lower(text), '{vx.COUNTED}', 1)) AS n_counted FROM documents",
)
def counted_nouns(t):
    return texts(t).select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit(vx.COUNTED), 1)).alias("n_counted"))
