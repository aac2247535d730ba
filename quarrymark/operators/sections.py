"""Sections of documents as tables: headings, their tree, and chunks with title and path.

The parent of a heading is the latest earlier one of a smaller level.  It is read off the last heading of every level, one running
value a level, so a document's headings are ordered once and nothing grows with their number.  An earlier heading is an ancestor
exactly when it comes after the last headings of all smaller levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.operators import corpus
from quarrymark.session import written

BLOCK = "\n\n"


def tree(heads: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``heads`` (doc, block, level, number, title) with section_id, parent_id, path and ordinal (from 1).

    Numbers of the document are its section ids; other headings count below their parent, marked ``u`` where the document has
    numbers.  A repeated id gets a running suffix.
    """
    deepest = heads.agg(F.coalesce(F.max("level"), F.lit(1))).first()[0]
    before = Window.partitionBy(doc).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def last(value: Column, over) -> list[Column]:
        """For every level the latest value before this row."""
        return [F.last(F.when(F.col("level") == n, value), ignorenulls=True).over(over).alias(f"at_{n}") for n in range(1, deepest + 1)]

    names = [f"at_{n}" for n in range(1, deepest + 1)]
    blocks = heads.select("*", *last(F.col("block"), before))
    smaller = [F.when(F.col("level") > n, F.col(f"at_{n}")) for n in range(1, deepest + 1)]
    parent = F.greatest(*smaller, F.lit(None).cast("int")) if len(smaller) > 1 else F.lit(None).cast("int")
    placed = blocks.select(*heads.columns, parent.alias("parent_block"))
    child = F.row_number().over(Window.partitionBy(doc, "parent_block").orderBy("block"))
    counted = placed.withColumn("child", child)

    entry = F.struct("block", "title", "child")
    known = counted.select("*", *last(entry, before))
    levels = F.array(*[F.when(F.col("level") > n, F.col(f"at_{n}")) for n in range(1, deepest + 1)])
    above = F.transform(
        levels, lambda x, i: F.when(x.isNotNull() & F.forall(F.slice("levels", 1, i), lambda y: y.isNull() | (y["block"] < x["block"])), x)
    )
    listed = known.withColumn("levels", levels).withColumn("above", F.filter(above, lambda x: x.isNotNull())).drop(*names, "levels")
    chain = F.concat(F.transform("above", lambda x: x["child"].cast("string")), F.array(F.col("child").cast("string")))
    own = Window.partitionBy(doc)
    numbered = F.max(F.col("number").isNotNull()).over(own)
    base = F.coalesce(F.col("number"), F.concat(F.when(numbered, "u").otherwise(""), F.array_join(chain, ".")))
    path = F.concat(F.transform("above", lambda x: x["title"]), F.array("title"))
    based = listed.withColumns({"base": base, "path": path, "ordinal": F.row_number().over(Window.partitionBy(doc).orderBy("block"))})
    times = F.row_number().over(Window.partitionBy(doc, "base").orderBy("block"))
    named = based.withColumn("times", times).withColumn(
        "section_id", F.when(F.col("times") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("times").cast("string")))
    )
    parents = named.select(F.col(doc).alias("p_doc"), F.col("block").alias("p_block"), F.col("section_id").alias("parent_id"))
    same = (F.col(doc) == F.col("p_doc")) & (F.col("parent_block") == F.col("p_block"))
    return named.join(parents, same, "left").select(*heads.columns, "ordinal", "section_id", "parent_id", "path")


def detected(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, block, begin, stop, h, n, total, title_block, document_title): every block with its heading, or null.

    Blocks are separated by blank lines.  Numbered candidates that count up without text between them are a list.  Without any
    heading, lines in capitals count.  A lone leading top heading without a number is the title of the document and no section.
    """
    rows = docs.select(doc, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), BLOCK)).alias("block", "b"))
    caps = F.when(~F.contains("b", F.lit("\n")), corpus.caps_heading(F.col("b")))
    marked = rows.select(doc, "block", F.length("b").alias("size"), corpus.heading(F.col("b")).alias("found"), caps.alias("caps"))
    order, own = Window.partitionBy(doc).orderBy("block"), Window.partitionBy(doc)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = marked.select(
        doc, "block", "size", "found", "caps", F.lag("found").over(order).alias("before"), F.lead("found").over(order).alias("after"),
        F.sum(F.col("size") + len(BLOCK)).over(upto).alias("stop"), (F.max("block").over(own) + 1).alias("n"),
    )
    listed = corpus.follows(F.col("before"), F.col("found")) | corpus.follows(F.col("found"), F.col("after"))
    headed = near.withColumn("found", F.when(~listed, F.col("found")))
    known = headed.withColumn("h", F.when(F.max(F.col("found").isNotNull()).over(own), F.col("found")).otherwise(F.col("caps")))
    top = F.coalesce((F.col("h.kind") == "markdown") & (F.col("h.level") == 1), F.lit(False))
    counted = known.withColumns(
        {"tops": F.count_if(top).over(own), "first": F.min(F.when(F.col("h").isNotNull(), F.col("block"))).over(own)}
    )
    title = (F.col("tops") == 1) & (F.col("block") == F.col("first")) & top & F.col("h.number").isNull()
    return counted.select(
        doc, "block", (F.col("stop") - F.col("size") - len(BLOCK)).alias("begin"), "stop", "h", "n",
        (F.max("stop").over(own) - len(BLOCK)).alias("total"),
        F.max(F.when(title, F.col("block"))).over(own).alias("title_block"),
        F.max(F.when(title, F.col("h.title"))).over(own).alias("document_title"),
    )


def sections(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, document_title, ordinal, section_id, parent_id, level, title, path, start, end, n_paragraphs).

    ``text[start:end]`` is what stands below the heading.  Text before the first heading is section 0, a document without headings
    is section 1.  A heading without text below it and a document without text have no section.
    """
    placed = written(detected(docs, doc, text), "blocks")
    is_head = F.col("h").isNotNull() & (F.col("block") != F.coalesce("title_block", F.lit(-1)))
    heads = placed.where(is_head).select(
        doc, "block", "begin", "stop", "n", "total", "document_title", "h.level", "h.number", "h.title"
    )
    following = Window.partitionBy(doc).orderBy("block")
    ended = tree(heads, doc).withColumns(
        {
            "n_paragraphs": F.coalesce(F.lead("block").over(following), F.col("n")) - F.col("block") - 1,
            "end": F.coalesce(F.lead("begin").over(following) - len(BLOCK), F.col("total")),
        }
    )
    columns = [doc, "document_title", "ordinal", "section_id", "parent_id", "level", "title", "path", "start", "end", "n_paragraphs"]
    headed = ended.withColumn("start", F.col("stop")).select(*columns)
    whole = placed.groupBy(doc).agg(
        F.max("n").alias("n"), F.max("total").alias("total"), F.max("title_block").alias("title_block"),
        F.max("document_title").alias("document_title"), F.min(F.when(is_head, F.col("block"))).alias("first"),
        F.min(F.when(is_head, F.col("begin"))).alias("until"),
        F.max(F.when(F.col("block") == F.col("title_block"), F.col("stop"))).alias("titled"),
    )
    alone = F.col("first").isNull()
    before = whole.select(
        doc, "document_title", F.lit(0).alias("ordinal"), F.when(alone, "1").otherwise("0").alias("section_id"),
        F.lit(None).cast("string").alias("parent_id"), F.when(alone, 1).otherwise(0).alias("level"),
        F.coalesce("document_title", F.lit("")).alias("title"), F.array().cast("array<string>").alias("path"),
        # text before the title belongs to the section as well
        F.when(F.col("title_block") == 0, F.col("titled")).otherwise(0).alias("start"),
        F.coalesce(F.col("until") - len(BLOCK), F.col("total")).alias("end"),
        (F.coalesce("first", "n") - F.col("title_block").isNotNull().cast("int")).alias("n_paragraphs"),
    )
    return headed.unionByName(before).where((F.col("n_paragraphs") > 0) & (F.col("end") > F.col("start")))


def chunks(docs: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, chunk_id, section_id, part, header, start, end, mid, text): chunks of every section, exact slices of the document."""
    body = F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start"))
    rows = found.join(docs.select(doc, text), doc).select(
        doc, "section_id", "document_title", "path", F.col("start").alias("base"), body.alias("body")
    )
    units = corpus.chunk_units(F.col("body"), paragraph=BLOCK)
    packed = rows.select("*", F.posexplode(corpus.pack_units(units)).alias("part", "c"))
    return packed.select(
        doc,
        F.concat_ws("#", F.col(doc).cast("string"), "section_id", (F.col("part") + 1).cast("string")).alias("chunk_id"),
        "section_id",
        (F.col("part") + 1).alias("part"),
        corpus.index_header(F.col("document_title"), F.col("path")).alias("header"),
        (F.col("base") + F.col("c.start")).alias("start"),
        (F.col("base") + F.col("c.end")).alias("end"),
        "c.mid",
        F.substring(F.col("body"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("text"),
    )
