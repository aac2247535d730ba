"""Shared fragments of the checking SQL."""

from __future__ import annotations

from quarrymark.functions.text import STOPWORDS

_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def sql_tokens(text: str) -> str:
    found = f"regexp_extract_all(lower({text}), '[0-9]+(?:[.,][0-9]+)*|\\p{{L}}+')"
    return f"list_transform({found}, lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN replace(t, ',', '') ELSE t END)"


def sql_terms(text: str) -> str:
    return f"list_filter({sql_tokens(text)}, lambda t: t NOT IN {_STOP})"


DOC_TERMS = f"doc_terms AS (SELECT doc_id, {sql_terms('text')} AS toks FROM documents)"
POSTINGS = (
    f"{DOC_TERMS}, posts AS (SELECT doc_id, term, count(*) AS tf FROM "
    "(SELECT doc_id, unnest(toks) AS term FROM doc_terms) GROUP BY ALL)"
)
STATS = "stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM doc_terms)"
IDF = "idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts GROUP BY term)"
QTERMS = f"qterms AS (SELECT DISTINCT item_id AS qid, unnest({sql_terms('text')}) AS term FROM benchmark)"
SCORES = (
    "scores AS (SELECT q.qid, p.doc_id, round(sum(i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(d.toks) / s.avgdl))), 6) AS score "
    "FROM qterms q JOIN posts p ON p.term = q.term JOIN idf i ON i.term = q.term JOIN doc_terms d ON d.doc_id = p.doc_id "
    "CROSS JOIN stats s GROUP BY q.qid, p.doc_id)"
)
BM25 = f"{POSTINGS}, {STATS}, {IDF}, {QTERMS}, {SCORES}"


def ranked(k: int, source: str = "scores", name: str = "ranked") -> str:
    return (
        f"{name} AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank "
        f"FROM {source} WHERE score > 0) WHERE rank <= {k})"
    )
