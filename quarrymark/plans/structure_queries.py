"""Section trees, sections and chunks of documents, and overlapping intervals.

Order lines give headings and spans of every shape: an order is a document, its lines are headings of levels 1 to 4, some of them
numbered, with a paragraph each.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymark.operators import corpus, intervals, sections
from quarrymark.plans.corpus_queries import page_texts
from quarrymark.plans.registry import named
from quarrymark.session import written

_LINES = (
    "ln AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, "
    "1 + l_partkey % 4 AS level, CASE WHEN l_suppkey % 3 = 0 THEN (1 + l_partkey % 2) || '.' || (l_suppkey % 2) END AS number, "
    "'Lot ' || l_returnflag || ' ' || l_linenumber AS title, 'Delivered by ' || l_suppkey || ' for ' || l_partkey || '.' AS body FROM lineitem)"
)
# the tree of headings h (doc_id, block, level, number, title)
_TREE = (
    "pa AS (SELECT h.*, (SELECT max(b.block) FROM h b WHERE b.doc_id = h.doc_id AND b.block < h.block AND b.level < h.level) AS pb FROM h), "
    "ch AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pb ORDER BY block) AS child FROM pa), "
    "wk AS (SELECT doc_id, block, CAST(child AS VARCHAR) AS derived, title AS path FROM ch WHERE pb IS NULL "
    "UNION ALL SELECT c.doc_id, c.block, w.derived || '.' || c.child, w.path || ' > ' || c.title FROM ch c JOIN wk w ON w.doc_id = c.doc_id AND w.block = c.pb), "
    "ba AS (SELECT c.*, w.path, coalesce(c.number, CASE WHEN bool_or(c.number IS NOT NULL) OVER (PARTITION BY c.doc_id) THEN 'u' ELSE '' END || w.derived) AS base FROM ch c JOIN wk w USING (doc_id, block)), "
    "tm AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY block) AS k FROM ba), "
    "se AS (SELECT *, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS section_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS ordinal FROM tm), "
    "tr AS (SELECT s.*, p.section_id AS parent_id FROM se s LEFT JOIN se p ON p.doc_id = s.doc_id AND p.block = s.pb)"
)


def order_lines(t):
    """(doc_id, pos, level, number, title, body) of every order line."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    number = F.concat_ws(".", (1 + F.col("l_partkey") % 2).cast("string"), (F.col("l_suppkey") % 2).cast("string"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"),
        F.row_number().over(order).alias("pos"),
        (1 + F.col("l_partkey") % 4).cast("int").alias("level"),
        F.when(F.col("l_suppkey") % 3 == 0, number).alias("number"),
        F.concat_ws(" ", F.lit("Lot"), "l_returnflag", "l_linenumber").alias("title"),
        F.concat(F.lit("Delivered by "), F.col("l_suppkey"), F.lit(" for "), F.col("l_partkey"), F.lit(".")).alias("body"),
    )


@named(
    "section_tree",
    f"WITH RECURSIVE {_LINES}, h AS (SELECT doc_id, pos AS block, level, number, title FROM ln), {_TREE} "
    "SELECT doc_id, block, level, ordinal, section_id, parent_id, path FROM tr",
)
def section_tree(t):
    heads = order_lines(t).select("doc_id", F.col("pos").alias("block"), "level", "number", "title")
    found = sections.tree(heads)
    return found.select("doc_id", "block", "level", "ordinal", "section_id", "parent_id", F.array_join("path", " > ").alias("path"))


def order_texts(t):
    """Orders as documents: a heading and a paragraph for every line; every second order begins with a sentence."""
    head = F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.when(F.col("number").isNotNull(), F.concat("number", F.lit(" "))).otherwise(""), "title")
    part = F.struct("pos", F.concat(head, F.lit("\n\n"), "body").alias("text"))
    joined = order_lines(t).groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # the lines of one order
    lead = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("About order "), F.col("doc_id"), F.lit(".\n\n"))).otherwise("")
    return joined.select("doc_id", F.concat(lead, F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")).alias("text"))


_SECTIONS = (
    f"{_LINES}, o AS (SELECT doc_id, count(*) FILTER (WHERE level = 1) AS tops, max(CASE WHEN pos = 1 AND level = 1 AND number IS NULL THEN 1 ELSE 0 END) AS lead, max(pos) AS n_lines, "
    "CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS intro FROM ln GROUP BY doc_id), "
    "d AS (SELECT *, tops = 1 AND lead = 1 AS titled FROM o), "
    "bl AS (SELECT doc_id, intro + 2 * (pos - 1) AS block, repeat('#', level) || ' ' || coalesce(number || ' ', '') || title AS text FROM ln JOIN d USING (doc_id) "
    "UNION ALL SELECT doc_id, intro + 2 * pos - 1, body FROM ln JOIN d USING (doc_id) UNION ALL SELECT doc_id, 0, 'About order ' || doc_id || '.' FROM d WHERE intro = 1), "
    "po AS (SELECT *, sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block) - length(text) - 2 AS first, sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block) - 2 AS last FROM bl), "
    "h AS (SELECT doc_id, intro + 2 * (pos - 1) AS block, level, number, title FROM ln JOIN d USING (doc_id) WHERE NOT (titled AND pos = 1)), "
)


@named(
    "corpus_sections",
    f"WITH RECURSIVE {_SECTIONS}{_TREE}, hd AS (SELECT doc_id, ordinal, section_id, parent_id, level, title, path, block + 1 AS a, block + 1 AS b, 1 AS n FROM tr), "
    "tt AS (SELECT doc_id, title FROM ln JOIN d USING (doc_id) WHERE titled AND pos = 1), "
    "pr AS (SELECT d.doc_id, 0 AS ordinal, CASE WHEN titled AND n_lines = 1 THEN '1' ELSE '0' END AS section_id, NULL AS parent_id, CASE WHEN titled AND n_lines = 1 THEN 1 ELSE 0 END AS level, coalesce(tt.title, '') AS title, '' AS path, "
    "CASE WHEN titled AND intro = 0 THEN 1 ELSE 0 END AS a, CASE WHEN titled THEN intro + 1 ELSE 0 END AS b, CASE WHEN titled THEN intro + 1 ELSE intro END AS n FROM d LEFT JOIN tt USING (doc_id)), "
    "al AS (SELECT * FROM hd UNION ALL SELECT * FROM pr WHERE n > 0) "
    "SELECT al.doc_id, tt.title AS document_title, ordinal, section_id, parent_id, level, al.title, path, n AS n_paragraphs, f.first AS start_at, l.last AS end_at "
    "FROM al LEFT JOIN tt USING (doc_id) JOIN po f ON f.doc_id = al.doc_id AND f.block = al.a JOIN po l ON l.doc_id = al.doc_id AND l.block = al.b",
)
def corpus_sections(t):
    """Headings found in texts, their tree, and where the text below each stands."""
    found = sections.sections(written(order_texts(t), "order-texts"))
    return found.select(
        "doc_id", "document_title", "ordinal", "section_id", "parent_id", "level", "title", F.array_join("path", " > ").alias("path"),
        "n_paragraphs", F.col("start").alias("start_at"), F.col("end").alias("end_at"),
    )


@named("corpus_chunks")
def corpus_chunks(t):
    """The whole chain over the pages: text, sections, chunks with their header, exact slices of the text."""
    docs = written(page_texts(t).withColumnRenamed("page_id", "doc_id"), "page-texts")
    found = written(sections.sections(docs), "page-sections")
    rows = sections.chunks(docs, found)
    return rows.select(
        "doc_id", "chunk_id", "section_id", "part", "header", "start", "end", "mid",
        corpus.count_words(F.col("text")).alias("n_tokens"), F.sha1("text").alias("digest"),
    )


@named(
    "interval_overlaps",
    "WITH s AS (SELECT l_partkey AS part, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS id, "
    "epoch(l_shipdate)::BIGINT // 86400 AS a, CAST(l_quantity AS BIGINT) * (l_suppkey % 40) AS n FROM lineitem) "
    "SELECT x.part, x.id AS a, y.id AS b, least(x.a + x.n, y.a + y.n) - greatest(x.a, y.a) AS shared, "
    "5 * (least(x.a + x.n, y.a + y.n) - greatest(x.a, y.a)) >= 4 * least(x.n, y.n) AS merge "
    "FROM s x JOIN s y ON x.part = y.part AND (x.a < y.a OR (x.a = y.a AND x.id < y.id)) AND y.a < x.a + x.n WHERE x.n > 0 AND y.n > 0",
)
def interval_overlaps(t):
    """Deliveries of one part that run at the same time; they last from no day to five years."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400)
    spans = t.lineitem.select(
        F.col("l_partkey").alias("part"),
        F.row_number().over(order).alias("id"),
        day.alias("start"),
        (day + F.col("l_quantity").cast("long") * (F.col("l_suppkey") % 40)).alias("end"),
    )
    met = intervals.overlaps(written(spans, "spans"), ["part"], "id")
    return met.select("part", "a", "b", "shared", (F.col("ratio") >= 0.8).alias("merge"))
