"""User-stated filters: the first words of benchmark passages are values, documents are questions, their first line is a constraint."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.operators import stated
from quarrymark.plans.corpus_queries import texts
from quarrymark.plans.registry import named

MARKERS = ["the", "of", "for", "in", "only", "with", "la", "de", "der", "les"]


@named(
    "user_stated_filters",
    "WITH v0 AS (SELECT regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*') AS ws FROM benchmark), "
    "v AS (SELECT DISTINCT * FROM (SELECT 'word' AS field, ws[1] AS value, ws[1:1] AS ts FROM v0 UNION ALL SELECT 'pair', array_to_string(ws[1:2], ' '), ws[1:2] FROM v0) WHERE len(ts) > 0), "
    "q AS (SELECT doc_id AS qid, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*') AS ws, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9][a-z0-9-]*') AS cs FROM documents), "
    "w AS (SELECT qid, ws, cs, unnest(range(1, len(ws) + 1)) AS i FROM q), "
    "o AS (SELECT w.qid, v.field, v.value, list_has_all(w.cs, v.ts) AS c, list_has_any(w.ws[greatest(i - 3, 1):i - 1], ['the', 'of', 'for', 'in', 'only', 'with', 'la', 'de', 'der', 'les']) AS m "
    "FROM w JOIN v ON w.ws[i] = v.ts[1] AND w.ws[i:i + len(v.ts) - 1] = v.ts) "
    "SELECT qid, field, value, count(*) AS n_found, bool_or(c) AS by_constraint, bool_or(m) AS by_marker FROM o GROUP BY qid, field, value HAVING bool_or(c) OR bool_or(m)",
)
def user_stated_filters(t):
    asked = stated.words(F.col("text"))
    first = t.benchmark.select(F.lit("word").alias("field"), F.get(asked, F.lit(0)).alias("value"))
    pairs = t.benchmark.select(F.lit("pair").alias("field"), F.array_join(F.slice(asked, 1, 2), " ").alias("value"))
    questions = texts(t).select(F.col("doc_id").alias("qid"), "text", F.substring_index("text", "\n", 1).alias("constraint"))
    return stated.stated(questions, first.unionByName(pairs).where("value <> ''"), MARKERS)
