"""Corpus transforms over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.operators import corpus, dedup
from quarrymark.operators.joins import attach
from quarrymark.operators.ordered import Split, islands
from quarrymark.plans.registry import named
from quarrymark.sources.tables import spread

DOC_LINES = (
    "dl AS (SELECT doc_id, source, l AS line, i AS pos FROM (SELECT doc_id, source, unnest(ls) AS l, generate_subscripts(ls, 1) AS i "
    "FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)))"
)


def texts(t, *columns: str):
    return spread(t.documents.select("doc_id", *columns, "text"), "doc_id")


def texts_of(t, hits, *columns: str):
    """The documents that occur in ranked lists, once each, for work that should not be repeated per query."""
    return texts(t, *columns).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")


def document_lines(t):
    """(doc_id, source, pos, line)."""
    rows = texts(t, "source").select("doc_id", "source", F.posexplode(corpus.lines(F.col("text"))).alias("pos", "line"))
    return rows.withColumn("pos", F.col("pos") + 1)


@named(
    "basic_normalise",
    "SELECT doc_id, sha1(list_aggregate(list_transform(string_split(regexp_replace(text, '[ \\t]+', ' ', 'g'), chr(10)), lambda l: trim(l)), 'string_agg', chr(10))) AS digest FROM documents",
)
def basic_normalise(t):
    return texts(t).select("doc_id", F.sha1(corpus.basic_normalise(F.col("text"))).alias("digest"))


@named(
    "dedup_lines",
    f"WITH {DOC_LINES}, nb AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM dl WHERE line <> ''), "
    "gone AS (SELECT doc_id, pos FROM nb WHERE line = prev) "
    "SELECT d.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped, sha1(string_agg(d.line, chr(10) ORDER BY d.pos) FILTER (WHERE g.pos IS NULL)) AS digest "
    "FROM dl d LEFT JOIN gone g USING (doc_id, pos) GROUP BY d.doc_id",
)
def dedup_lines(t):
    rows = texts(t).withColumn("kept", corpus.drop_repeated_lines(F.col("text")))
    n = lambda c: F.size(corpus.lines(F.col(c)))
    return rows.select(
        "doc_id", n("text").alias("n_lines"), (n("text") - n("kept")).alias("n_dropped"), F.sha1("kept").alias("digest")
    )


@named(
    "boilerplate_lines",
    f"WITH {DOC_LINES}, b AS (SELECT line FROM dl WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= least(3, greatest(2, ceil((SELECT count(*) FROM documents) / 2)))) "
    "SELECT d.doc_id, count(*) AS n_boilerplate, CAST(sum(length(d.line)) AS BIGINT) AS n_chars FROM dl d JOIN b USING (line) GROUP BY d.doc_id",
)
def boilerplate_lines(t):
    """Characters of every document that sit in lines shared by several documents."""
    rows = document_lines(t).where(F.trim("line") != "").select("doc_id", "line", F.sha1("line").alias("digest"))
    per_doc = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.max(F.length("line")).alias("chars"))
    shared = per_doc.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    need = t.documents.agg(F.least(F.lit(3), F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)) / 2)))).scalar()
    return (
        attach(per_doc, shared.where(F.col("n") >= need), ["digest"])
        .groupBy("doc_id")
        .agg(F.sum("times").alias("n_boilerplate"), F.sum(F.col("times") * F.col("chars")).alias("n_chars"))
    )


@named(
    "header_footer_keys",
    "WITH p AS (SELECT source, doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') AS ls FROM documents), "
    "e AS (SELECT source, doc_id, ls, CASE WHEN len(ls) >= 6 THEN 2 ELSE 1 END AS k FROM p), "
    "s AS (SELECT source, doc_id, 'top' AS side, unnest(ls[1:k]) AS line FROM e UNION ALL SELECT source, doc_id, 'bottom', unnest(ls[greatest(len(ls) - k + 1, 1):]) FROM e WHERE len(ls) > k), "
    "g AS (SELECT source, side, regexp_replace(lower(line), '\\d+', '#', 'g') AS key, count(DISTINCT doc_id) AS n FROM s GROUP BY ALL), "
    "n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source) "
    "SELECT g.source, g.side, g.key, g.n AS n_pages FROM g JOIN n USING (source) WHERE n.pages >= 3 AND g.n >= 0.6 * n.pages",
)
def header_footer_keys(t):
    """Edge lines that recur over the pages of one source."""
    edges = texts(t, "source").select(
        "source", "doc_id", F.explode(corpus.edge_lines(F.col("text"))).alias("e")
    ).select("source", "doc_id", "e.side", corpus.line_key(F.col("e.line")).alias("key"))
    counts = edges.distinct().groupBy("source", "side", "key").agg(F.count(F.lit(1)).alias("n_pages"))
    pages = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 3")
    return counts.join(pages, "source").where(F.col("n_pages") >= 0.6 * F.col("pages")).select(
        "source", "side", "key", "n_pages"
    )


@named(
    "dehyphenate",
    "SELECT doc_id, length(regexp_replace(replace(text, ' ', '-' || chr(10)), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g')) AS n_chars FROM documents",
)
def dehyphenate(t):
    """Every space is made a hyphenated line break first, so the rule has something to join."""
    broken = F.replace(F.col("text"), F.lit(" "), F.lit("-\n"))
    return texts(t).select("doc_id", F.length(corpus.dehyphenate(broken)).alias("n_chars"))


_H = {
    "md": "^(#{1,6})\\s+(.+?)\\s*#*\\s*$",
    "sign": "^§\\s*(\\d+(?:\\.\\d+)*)\\s*[-–—:.)]?\\s*(.*)$",
    "word": "(?i)^(?:section|article|clause|part|chapter)\\s+(\\d+(?:\\.\\d+)*)\\s*[-–—:.)]?\\s*(.*)$",
    "num": "^(\\d+(?:\\.\\d+){0,4})[.)]?\\s+(\\S.*)$",
}
_NW = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+'))"


@named(
    "heading_match",
    f"WITH {DOC_LINES}, h AS (SELECT doc_id, pos, trim(line) AS s FROM dl), m AS (SELECT doc_id, pos, CASE "
    f"WHEN regexp_matches(s, '{_H['md']}') THEN 'markdown' "
    f"WHEN regexp_matches(s, '{_H['sign']}') AND {_NW.format('regexp_extract(s, ' + chr(39) + _H['sign'] + chr(39) + ', 2)')} <= 12 THEN 'section_sign' "
    f"WHEN regexp_matches(s, '{_H['word']}') AND {_NW.format('regexp_extract(s, ' + chr(39) + _H['word'] + chr(39) + ', 2)')} <= 12 THEN 'section_word' "
    f"WHEN regexp_matches(s, '{_H['num']}') AND {_NW.format('regexp_extract(s, ' + chr(39) + _H['num'] + chr(39) + ', 2)')} <= 12 "
    f"AND NOT regexp_matches(s, '[.,;:?!]$') AND regexp_matches(regexp_extract(s, '{_H['num']}', 2), '^[\\p{{Lu}}\\d]') THEN 'numbered' "
    f"WHEN length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) >= 3 AND NOT regexp_matches(regexp_replace(s, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Lu}}]') AND {_NW.format('s')} <= 12 AND NOT regexp_matches(s, '[.,;]$') THEN 'caps' "
    "ELSE 'body' END AS kind FROM h) SELECT kind, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY kind",
)
def heading_match(t):
    """What every line of the corpus is: a kind of heading, or body text."""
    rows = document_lines(t).select("doc_id", "line")
    kind = F.coalesce(corpus.heading(F.col("line"))["kind"], corpus.caps_heading(F.col("line"))["kind"], F.lit("body"))
    per_doc = rows.groupBy("doc_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("kind").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_docs"))


@named(
    "numbered_runs",
    "WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = lag(l_linenumber) OVER w + 1 THEN 0 ELSE 1 END AS start FROM lineitem "
    "WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)), "
    "r AS (SELECT l_suppkey, sum(start) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS island FROM s), "
    "g AS (SELECT l_suppkey, island, count(*) AS n FROM r GROUP BY ALL) "
    "SELECT l_suppkey, count(*) AS n_runs, max(n) AS longest, count(*) FILTER (WHERE n >= 2) AS n_lists FROM g GROUP BY l_suppkey",
)
def numbered_runs(t):
    """Runs of sequential numbers in the order book of every supplier; a run of two or more is a list."""
    lines = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    split = Split(["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], F.floor(F.col("l_orderkey") / 100_000))
    runs = islands(lines, split, "l_linenumber").groupBy("l_suppkey", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max("n").alias("longest"), F.count_if(F.col("n") >= 2).alias("n_lists")
    )


@named(
    "page_lookup",
    f"WITH {DOC_LINES}, g AS (SELECT doc_id, pos, length(line) AS n, CASE WHEN pos = 1 THEN 0 WHEN NOT regexp_matches(coalesce(lag(line) OVER w, ''), '[.!?:;\"”)]\\s*$') AND regexp_matches(line, '^\\s*\\p{{Ll}}') THEN 1 ELSE 2 END AS gap FROM dl WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
    "o AS (SELECT doc_id, pos, n, sum(gap + n) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM g) "
    "SELECT d.doc_id, max(o.pos) AS n_pages, max(o.e) AS n_chars, coalesce(min(o.pos) FILTER (WHERE o.e - o.n <= d.n_chars // 2 AND d.n_chars // 2 <= o.e), max(o.pos)) AS page "
    "FROM documents d JOIN o USING (doc_id) GROUP BY d.doc_id",
)
def page_lookup(t):
    """Lines as pages: joined offsets, and the page that holds the middle character."""
    offsets = corpus.page_offsets(corpus.lines(F.col("text")))
    rows = texts(t, "n_chars").select("doc_id", F.floor(F.col("n_chars") / 2).alias("middle"), offsets.alias("o"))
    return rows.select(
        "doc_id",
        F.size("o").alias("n_pages"),
        F.element_at("o", -1)["end"].alias("n_chars"),
        corpus.page_at(F.col("o"), F.col("middle")).alias("page"),
    )


_WINDOWS = (
    "w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS ws FROM documents), "
    "s AS (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(CAST(ceil((len(ws) - 50) / 40) AS BIGINT), 0) + 1 END)) AS pos FROM w)"
)


@named(
    "word_windows",
    f"WITH {_WINDOWS} SELECT doc_id, pos, least(len(ws), pos * 40 + 50) - pos * 40 AS n_words, sha1(array_to_string(ws[pos * 40 + 1:pos * 40 + 50], ' ')) AS digest FROM s",
)
def word_windows(t):
    rows = texts(t).select("doc_id", F.explode(corpus.word_windows(F.col("text"), 50, 10)).alias("w"))
    return rows.select(
        "doc_id",
        "w.pos",
        (F.col("w.last") - F.col("w.first")).alias("n_words"),
        F.sha1("w.text").alias("digest"),
    )


@named(
    "span_overlap_pairs",
    f"WITH {_WINDOWS}, p AS (SELECT doc_id, pos, pos * 40 AS a, least(len(ws), pos * 40 + 50) AS b FROM s), "
    "j AS (SELECT x.doc_id AS document, x.pos AS pos_a, y.pos AS pos_b, least(x.b, y.b) - greatest(x.a, y.a) AS shared, least(x.b - x.a, y.b - y.a) AS shorter FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.pos < y.pos AND y.a < x.b) "
    "SELECT document, pos_a, pos_b, shared, round(shared / greatest(shorter, 1), 6) AS ratio, round(shared / greatest(shorter, 1), 6) >= 0.8 AS merge FROM j WHERE shared > 0",
)
def span_overlap_pairs(t):
    rows = texts(t).select("doc_id", F.explode(corpus.word_windows(F.col("text"), 50, 10)).alias("w"))
    spans = rows.select(
        F.col("doc_id").alias("document"),
        F.lit("body").alias("section"),
        "w.pos",
        F.col("w.first").alias("start"),
        F.col("w.last").alias("end"),
        F.lit(2).alias("reach"),
    )
    return dedup.overlapping_spans(spans).drop("section")


@named(
    "document_ids",
    "WITH n AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '/(\\d+)(?:\\.html)?(?:[/?#]|$)', 1), ''), 'page') AS native FROM pages), "
    "k AS (SELECT page_id, native, row_number() OVER (PARTITION BY native ORDER BY page_id) AS k FROM n) "
    "SELECT page_id, CASE WHEN k = 1 THEN native ELSE native || '_' || k END AS document_id, (CASE WHEN k = 1 THEN native ELSE native || '_' || k END) || ' §1' AS citation FROM k",
)
def document_ids(t):
    """Native id from the address; repeated ids get a running suffix."""
    native = F.coalesce(
        F.nullif(F.regexp_extract("url", r"/(\d+)(?:\.html)?(?:[/?#]|$)", 1), F.lit("")), F.lit("page")
    )
    rows = t.pages.select("page_id", native.alias("native"))
    split = Split(["native"], ["page_id"], F.floor(F.col("page_id") / 100_000))
    numbered = split.position(rows, "k")
    chosen = F.when(F.col("k") == 1, F.col("native")).otherwise(F.concat_ws("_", "native", F.col("k").cast("string")))
    return numbered.select("page_id", chosen.alias("document_id"), F.concat(chosen, F.lit(" §1")).alias("citation"))


@named(
    "index_headers",
    "SELECT doc_id, array_to_string(CASE WHEN lang = source THEN [lang] ELSE [lang, source] END, ' > ') || ': ' || regexp_replace(text, '\\s+', ' ', 'g') AS header, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS n_words FROM documents",
)
def index_headers(t):
    header = corpus.index_header(F.col("lang"), F.array("source", "source"))
    start = F.regexp_replace("text", r"\s+", " ")
    return texts(t, "lang", "source").select(
        "doc_id",
        F.concat(header, F.lit(": "), start).alias("header"),
        corpus.count_words(F.col("text")).alias("n_words"),
    )


@named(
    "corpus_fingerprint",
    "SELECT source, sha256(string_agg(doc_id || chr(9) || sha256(text) || chr(10), '' ORDER BY doc_id)) AS fingerprint, count(*) AS n_docs "
    "FROM (SELECT doc_id // 50 AS source, doc_id, text FROM documents) GROUP BY source",
)
def corpus_fingerprint(t):
    """One digest per block of fifty documents: order-sensitive, bounded per group."""
    rows = t.documents.select(
        F.floor(F.col("doc_id") / 50).alias("source"),
        "doc_id",
        F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.sha2("text", 256), F.lit("\n")).alias("entry"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))), lambda e: e["entry"]), "")
    return rows.groupBy("source").agg(F.sha2(joined, 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_docs"))


@named(
    "manifest_hash",
    "SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}') AS manifest FROM documents",
)
def manifest_hash(t):
    """Digest of the canonical JSON (sorted names, no spaces) of a record."""
    return t.documents.select("doc_id", F.sha2(F.to_json(F.struct("lang", "n_chars", "source")), 256).alias("manifest"))


def page_texts(t):
    pages = spread(t.pages.select("page_id", "html"), "page_id")
    return pages.select("page_id", corpus.html_text(F.col("html")).alias("text"))


@named("html_sections")
def html_sections(t):
    """Sections of every page with id, level, title path and the paragraphs below the heading; what stands before the first
    heading, or a whole page without one, is section "0"."""
    blocks = page_texts(t).select("page_id", F.split("text", r"\n\n").alias("blocks"))
    tree = blocks.withColumn("tree", corpus.section_tree(F.col("blocks"))).withColumn("n", F.size("blocks"))
    rows = tree.select("page_id", "n", "tree", F.posexplode("tree").alias("ordinal", "s"))
    following = F.coalesce(F.try_element_at("tree", F.col("ordinal") + 2)["block"], F.col("n"))
    headed = rows.select(
        "page_id",
        (F.col("ordinal") + 1).alias("ordinal"),
        F.col("s.sid").alias("section_id"),
        "s.level",
        "s.title",
        F.array_join("s.path", " > ").alias("path"),
        (following - F.col("s.block") - 1).alias("n_paragraphs"),
    )
    before = F.coalesce(F.try_element_at("tree", F.lit(1))["block"], F.col("n"))
    empty = F.lit("")
    preamble = tree.select(
        "page_id",
        F.lit(0).alias("ordinal"),
        F.lit("0").alias("section_id"),
        F.lit(0).alias("level"),
        empty.alias("title"),
        empty.alias("path"),
        before.alias("n_paragraphs"),
    )
    return headed.unionByName(preamble.where("n_paragraphs > 0"))


@named("join_wrapped_lines")
def join_wrapped_lines(t):
    joined = corpus.join_wrapped(F.col("text"))
    return texts(t).select("doc_id", joined.alias("j")).select(
        "doc_id", F.size(F.split("j", r"\n\n")).alias("n_blocks"), F.length("j").alias("n_chars"), F.sha1("j").alias("digest")
    )


def chunks(t):
    """(doc_id, chunk, start, end, mid, text): exact slices of the document."""
    packed = texts(t).select(
        "doc_id", "text", F.posexplode(corpus.pack_units(corpus.chunk_units(F.col("text")))).alias("chunk", "c")
    )
    slice_ = F.substring(F.col("text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    return packed.select("doc_id", "chunk", "c.start", "c.end", "c.mid", slice_.alias("text"))


@named("chunk_sections")
def chunk_sections(t):
    return chunks(t).select(
        "doc_id", "chunk", "start", "end", "mid", corpus.count_words(F.col("text")).alias("n_tokens"), F.sha1("text").alias("digest")
    )


@named("sentence_spans")
def sentence_spans(t):
    rows = texts(t).select("doc_id", F.posexplode(corpus.sentence_spans(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", "pos", "s.start", "s.end", F.sha1("s.text").alias("digest"))
