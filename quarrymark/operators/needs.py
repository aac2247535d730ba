"""Needs and their parts: slots to fill, queries to ask, constraints over turns; what to strip from pages and generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.functions import lexicon
from quarrymark.operators import corpus
from quarrymark.operators.dialogue import RESTRICTIONS, words

EDGE_SHARE = 0.6
EDGE_PAGES = 3

# What stands between a pair of brackets and holds no bracket itself.
BRACKETED = r"[\[(][^\[\]()]*[\])]"
LABEL_KINDS = ("E", "F")
LABEL_SEPARATORS = ",;/"

# Kinds of value a question can ask for, by the words it asks with; the first that occurs counts.
ASKED = {
    kind: r"\b(?:" + lexicon.longest_first(asked) + r")\b"
    for kind, asked in {
        "amount": lexicon.phrases("how much|what", "cost|fee|price") + ["how much", "how expensive"],
        "duration": ["how long", "how soon", *lexicon.phrases("how many", "days|weeks|months|years|hours|minutes")],
        "count": ["how many", "what number"],
        "age": ["how old", "what age"],
        "frequency": ["how often", "how frequently"],
        "time": ["when", *lexicon.phrases("what|which", "time|date|day|month|year")],
        "measure": ["how far", "how high", "how large", "how tall", "how wide", "what size"],
    }.items()
}


def edge_removals(pages: DataFrame, group: str, key: str, text: str = "text") -> DataFrame:
    """(key, n_repeated, n_page_numbers, lines): edge lines that recur on at least EDGE_SHARE of a group's pages, and page numbers.

    Only edge lines are exploded and counted; groups of fewer than EDGE_PAGES pages have no repeated edges.
    """
    edges = pages.select(group, key, F.explode(corpus.edge_lines(F.col(text))).alias("e")).select(
        group, key, "e.side", "e.line", corpus.line_key(F.col("e.line")).alias("line_key")
    )
    seen = edges.select(group, key, "side", "line_key").distinct().groupBy(group, "side", "line_key").agg(F.count(F.lit(1)).alias("on"))
    sizes = pages.groupBy(group).agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= EDGE_PAGES)
    repeated = seen.join(sizes, group).where(F.col("on") >= EDGE_SHARE * F.col("pages")).select(group, "side", "line_key", F.lit(True).alias("again"))
    marked = edges.join(repeated, [group, "side", "line_key"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    number = F.col("line").rlike(corpus.PAGE_MARKER) & ~F.col("again")
    per = marked.groupBy(key).agg(
        F.count_if("again").alias("n_repeated"),
        F.count_if(number).alias("n_page_numbers"),
        F.array_sort(F.collect_list(F.when(F.col("again") | number, F.col("line")))).alias("lines"),
    )
    zero = F.lit(0).cast("long")
    return pages.select(key).join(per, key, "left").select(
        key, F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce("n_page_numbers", zero).alias("n_page_numbers"), "lines"
    )


def without_edges(pages: DataFrame, group: str, key: str, text: str = "text") -> DataFrame:
    """(key, text, removed): the pages without their recurring edge lines and page numbers, and the lines that went, in order.

    What recurs in a group stands on more than half of its pages, so it is a handful of lines; they are joined to the pages as one
    short list.
    """
    edges = pages.select(group, key, F.explode(corpus.edge_lines(F.col(text))).alias("e")).select(
        group, key, "e.side", corpus.line_key(F.col("e.line")).alias("line_key")
    )
    seen = edges.distinct().groupBy(group, "side", "line_key").agg(F.count(F.lit(1)).alias("on"))
    sizes = pages.groupBy(group).agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= EDGE_PAGES)
    again = seen.join(sizes, group).where(F.col("on") >= EDGE_SHARE * F.col("pages"))
    lists = again.groupBy(group).agg(F.collect_set(F.struct("side", "line_key")).alias("again"))
    rows = pages.select(group, key, corpus.lines(F.coalesce(F.col(text), F.lit(""))).alias("ls")).join(lists, group, "left")
    full = F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.trim(F.get("ls", i)) != "")
    placed = rows.withColumn("full", full)
    k = F.when(F.size("full") >= 6, 2).otherwise(1)
    top = F.slice("full", 1, k)
    bottom = F.when(F.size("full") > k, F.slice("full", F.greatest(F.size("full") - k + 1, F.lit(1)), k)).otherwise(F.array().cast("array<int>"))
    sided = placed.withColumns({"top": top, "bottom": bottom})

    def goes(line: Column, i: Column) -> Column:
        side = F.when(F.array_contains("top", i), "top").when(F.array_contains("bottom", i), "bottom")
        known = F.exists("again", lambda a: (a["side"] == side) & (a["line_key"] == corpus.line_key(line)))
        return F.coalesce(side.isNotNull() & (F.coalesce(known, F.lit(False)) | line.rlike(corpus.PAGE_MARKER)), F.lit(False))

    return sided.select(
        key,
        F.array_join(F.filter("ls", lambda line, i: ~goes(line, i)), "\n").alias("text"),
        F.filter("ls", goes).alias("removed"),
    )


def _labels_only(bracketed: Column) -> Column:
    """Whether a bracket holds a list of labels of evidence or facts, a letter and a number each, and nothing else."""
    inner = F.substring(bracketed, F.lit(2), F.length(bracketed) - 2)
    entries = F.transform(F.split(F.translate(inner, LABEL_SEPARATORS, "\n" * len(LABEL_SEPARATORS)), "\n"), lambda e: F.trim(e))
    number = lambda e: F.substring(e, F.lit(2), F.length(e))
    return F.forall(entries, lambda e: F.substring(e, 1, 1).isin(*LABEL_KINDS) & number(e).rlike("^[0-9]+$"))


def markers(text: Column) -> Column:
    """Brackets that hold labels only."""
    return F.filter(F.regexp_extract_all(text, F.lit(BRACKETED), 0), _labels_only)


def without_markers(text: Column) -> Column:
    """The text without its labels, and without the blanks they leave before punctuation.

    The text is cut at its brackets; those that hold labels are left out with the blanks before them.  Pieces and brackets are each found
    once a text and paired by place; the last piece has no bracket.
    """
    between = F.split(text, BRACKETED)
    brackets = F.regexp_extract_all(text, F.lit(BRACKETED), 0)

    def piece(part: Column, bracket: Column) -> Column:
        gone = F.coalesce(_labels_only(bracket), F.lit(False))
        return F.when(gone, F.rtrim(part)).otherwise(F.concat(part, F.coalesce(bracket, F.lit(""))))

    bare = F.array_join(F.zip_with(between, brackets, piece), "")
    return F.trim(F.regexp_replace(bare, r"(?<! )[ ]+([.,;:!?])", "$1"))


def asked_kind(text: Column) -> Column:
    """Kind of value a text asks for, or null."""
    said = F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0), " ")
    return F.coalesce(*[F.when(said.rlike(rx), F.lit(kind)) for kind, rx in ASKED.items()])


def restricts(text: Column) -> Column:
    return F.exists(words(text), lambda w: w.isin(RESTRICTIONS))


def queries(asked: DataFrame, conditions: DataFrame) -> DataFrame:
    """(session, utterance, ord, n_own, n_added, digest): own terms and those of the utterance's conditions, each once."""
    of_turn = ["session", "utterance"]
    added = conditions.select(*of_turn, F.explode("terms").alias("term")).groupBy(*of_turn).agg(F.collect_set("term").alias("more"))
    rows = asked.join(added, of_turn, "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    both = F.array_join(F.array_sort(F.array_union("terms", "more")), " ")
    return rows.select(
        *of_turn, "ord", F.size("terms").alias("n_own"), F.size(F.array_except("more", "terms")).alias("n_added"), F.sha1(both).alias("digest")
    )


def slots(asked: DataFrame, conditions: DataFrame) -> DataFrame:
    """(session, utterance, ord, slot, kind, asked, terms): one value or fact slot a need, one condition slot a constraint."""
    kind = asked_kind(F.col("clause"))
    own = asked.select(
        "session",
        "utterance",
        "ord",
        F.lit(0).alias("part"),
        F.when(kind.isNull(), "fact").otherwise("value").alias("kind"),
        F.coalesce(kind, F.lit("")).alias("asked"),
        "terms",
    )
    needed = asked.select("session", "utterance", "ord").join(conditions, ["session", "utterance"])
    more = needed.select(
        "session", "utterance", "ord", (F.col("at") + 1).alias("part"), F.lit("condition").alias("kind"), F.lit("").alias("asked"), "terms"
    )
    place = F.row_number().over(Window.partitionBy("session", "utterance", "ord").orderBy("part"))  # slots of one need
    return own.unionByName(more).select("session", "utterance", "ord", place.alias("slot"), "kind", "asked", "terms")


def operations(constraints: DataFrame) -> DataFrame:
    """(session, utterance, ord, head, operation, replaces): set, update or repeat, by the last constraint with the same head."""
    headed = constraints.withColumn("sorted", F.array_sort("terms"))
    earlier = Window.partitionBy("session", "head").orderBy("utterance", "ord")
    before = F.lag("sorted").over(earlier)
    operation = F.when(before.isNull(), "set").when(before == F.col("sorted"), "repeat").otherwise("update")
    return headed.select("session", "utterance", "ord", "head", operation.alias("operation"), F.lag("utterance").over(earlier).alias("replaces"))


def applicability(value: Column, wanted: Column, name: str) -> Column:
    """``kept``, or the reason why evidence that states another specific value does not apply."""
    fits = value.isNull() | (value == wanted) | (F.lower(value) == "all")
    return F.when(fits, "kept").otherwise(f"not_applicable:{name}")
