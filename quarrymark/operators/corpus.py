"""Corpus transforms inside one document row: lines, pages, headings, sections, chunks.

A document is one row, so everything here is an array expression over that row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymark.config import CHUNKING
from quarrymark.functions.text import let

# Invisible characters, page markers, list items and heading shapes.
INVISIBLE = "​‌‍⁠﻿­"
PAGE_MARKER = r"(?i)^\s*(?:[-–—]\s*)?(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?(?:\s*[-–—])?\s*$"
LIST_ITEM = r"^\s*(?:[-*•▪◦·]|\(?\d+[.)]|\(?[a-zA-Z][.)]|\([ivxIVX]+\))\s+"
MARKDOWN = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
SECTION_SIGN = r"^§\s*(\d+(?:\.\d+)*)\s*[-–—:.)]?\s*(.*)$"
SECTION_WORD = r"(?i)^(?:section|article|clause|part|chapter)\s+(\d+(?:\.\d+)*)\s*[-–—:.)]?\s*(.*)$"
NUMBERED = r"^(\d+(?:\.\d+){0,4})[.)]?\s+(\S.*)$"
WORD = r"[\p{L}\p{N}_]+"
# Abbreviations that do not end a sentence.
ABBREVIATIONS = (
    "e.g i.e etc vs no nos dr mr mrs ms st approx fig sec art inc ltd co cf al jr sr dept est max min"
).split()


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def basic_normalise(text: Column) -> Column:
    """One kind of line end, single spaces, trimmed lines, no invisible characters."""
    t = F.translate(text, INVISIBLE, "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t ]+", " ")
    return F.regexp_replace(t, r"(?m)^ | $", "")


def drop_repeated_lines(text: Column) -> Column:
    """Drop a line equal to the last non-blank line before it."""

    def body(ls: Column) -> Column:
        numbered = F.transform(ls, lambda l, i: F.struct(i.alias("i"), l.alias("l")))
        return let(F.filter(numbered, lambda x: x["l"] != ""), lambda nb: keep(ls, nb))

    def keep(ls: Column, nb: Column) -> Column:
        following = F.slice(nb, 2, F.greatest(F.size(nb), F.lit(1)))
        twins = F.filter(
            F.zip_with(nb, following, lambda a, b: F.when(a["l"] == b["l"], b["i"])), lambda i: i.isNotNull()
        )
        return let(twins, lambda tw: F.filter(ls, lambda l, i: ~F.array_contains(tw, i)))

    return F.array_join(let(lines(text), body), "\n")


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"([A-Za-z])-\n([a-z])", "$1$2")


def line_key(line: Column) -> Column:
    """Running headers differ only in their page number."""
    return F.regexp_replace(F.lower(line), r"\d+", "#")


def edge_lines(text: Column) -> Column:
    """Top and bottom lines of a page: two each, one each on pages of fewer than six lines."""

    def body(nb: Column) -> Column:
        k = F.when(F.size(nb) >= 6, 2).otherwise(1)
        top = F.transform(F.slice(nb, 1, k), lambda l: F.struct(F.lit("top").alias("side"), l.alias("line")))
        low = F.slice(nb, F.greatest(F.size(nb) - k + 1, F.lit(1)), k)
        bottom = F.transform(low, lambda l: F.struct(F.lit("bottom").alias("side"), l.alias("line")))
        return F.when(F.size(nb) > k, F.concat(top, bottom)).otherwise(top)

    return let(F.filter(lines(text), lambda l: F.trim(l) != ""), body)


def heading(line: Column, max_words: int = CHUNKING.max_heading_words) -> Column:
    """(kind, level, number, title) of a heading line, NULL for body text."""
    s = F.trim(line)
    part = lambda rx, g, of=s: F.regexp_extract(of, rx, g)
    dots = lambda n: F.length(n) - F.length(F.translate(n, ".", "")) + 1

    def make(kind: str, level: Column, number: Column, title: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            level.cast("int").alias("level"),
            number.cast("string").alias("number"),
            title.alias("title"),
        )

    md = F.trim(part(MARKDOWN, 2))
    depth = F.length(part(MARKDOWN, 1))
    result = F.when(F.lit(False), make("none", F.lit(0), F.lit(None), s))
    for rx in (NUMBERED, SECTION_SIGN, SECTION_WORD):
        inner = F.regexp_extract(md, rx, 2)
        title = F.when(F.trim(inner) == "", md).otherwise(F.trim(inner))
        fits = s.rlike(MARKDOWN) & md.rlike(rx) & (count_words(inner) <= max_words)
        result = result.when(fits, make("markdown", depth, F.regexp_extract(md, rx, 1), title))
    result = result.when(s.rlike(MARKDOWN), make("markdown", depth, F.lit(None), md))
    for kind, rx in (("section_sign", SECTION_SIGN), ("section_word", SECTION_WORD)):
        fits = s.rlike(rx) & (count_words(part(rx, 2)) <= max_words)
        result = result.when(fits, make(kind, dots(part(rx, 1)), part(rx, 1), F.trim(part(rx, 2))))
    title = F.trim(part(NUMBERED, 2))
    fits = (
        s.rlike(NUMBERED)
        & (count_words(title) <= max_words)
        & ~title.rlike(r"[.,;:?!]$")
        & title.rlike(r"^[\p{Lu}\d]")
    )
    return result.when(fits, make("numbered", dots(part(NUMBERED, 1)), part(NUMBERED, 1), title))


def caps_heading(line: Column, max_words: int = CHUNKING.max_heading_words) -> Column:
    """A short line in capitals with at least three letters."""
    s = F.trim(line)
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    fits = (
        (F.length(letters) >= 3)
        & ~letters.rlike(r"[^\p{Lu}]")
        & (count_words(s) <= max_words)
        & ~s.rlike(r"[.,;]$")
    )
    return F.when(
        fits,
        F.struct(
            F.lit("caps").alias("kind"),
            F.lit(1).alias("level"),
            F.lit(None).cast("string").alias("number"),
            F.initcap(s).alias("title"),
        ),
    )


def join_wrapped(text: Column) -> Column:
    """Join hard-wrapped lines of a block; headings, list items and table rows stay on their own line."""

    def shielded(l: Column) -> Column:
        return l.rlike(MARKDOWN) | l.startswith("|") | heading(l).isNotNull() | caps_heading(l).isNotNull()

    def block(b: Column) -> Column:
        rows = F.transform(
            F.filter(F.split(b, "\n"), lambda l: F.trim(l) != ""),
            lambda l: F.struct(
                l.alias("l"), (shielded(l) | l.rlike(LIST_ITEM)).alias("own"), shielded(l).alias("closed")
            ),
        )
        start = F.struct(
            F.array().cast("array<string>").alias("out"),
            F.lit("").alias("open"),
            F.lit(True).alias("closed"),
        )

        def flush(acc: Column) -> Column:
            return F.when(acc["open"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))

        def step(acc: Column, r: Column) -> Column:
            fresh = F.struct(flush(acc).alias("out"), r["l"].alias("open"), r["closed"].alias("closed"))
            glued = F.struct(
                acc["out"].alias("out"), F.concat_ws(" ", acc["open"], r["l"]).alias("open"), F.lit(False).alias("closed")
            )
            return F.when(r["own"] | acc["closed"], fresh).otherwise(glued)

        merged = F.aggregate(rows, start, step, flush)
        return F.array_join(
            F.transform(
                merged,
                lambda l: F.when(l.rlike(MARKDOWN) | heading(l).isNotNull(), F.concat(F.lit("\n"), l, F.lit("\n"))).otherwise(l),
            ),
            "\n",
        )

    joined = F.array_join(F.transform(F.split(text, r"\n{2,}"), block), "\n\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{2,}", "\n\n"), r"^\n+|\n+$", "")


def page_offsets(pages: Column) -> Column:
    """(page, start, end) of pages joined in order: with a space where a sentence runs on, else with a blank line."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("last"), F.array().cast("array<struct<page:int,start:int,end:int>>").alias("out"))

    def step(acc: Column, page: Column) -> Column:
        runs_on = ~acc["last"].rlike(r"[.!?:;\"”)]\s*$") & page.rlike(r"^\s*\p{Ll}")
        gap = F.when(F.size(acc["out"]) == 0, 0).when(runs_on, 1).otherwise(2)
        begin = acc["pos"] + gap
        end = begin + F.length(page)
        entry = F.struct((F.size(acc["out"]) + 1).alias("page"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("pos"), page.alias("last"), F.concat(acc["out"], F.array(entry)).alias("out"))

    return F.aggregate(pages, start, step, lambda acc: acc["out"])


def page_at(offsets: Column, position: Column) -> Column:
    """First page whose span holds the position, else the last page."""
    inside = F.filter(offsets, lambda o: (o["start"] <= position) & (position <= o["end"]))
    return F.coalesce(F.try_element_at(inside, F.lit(1)), F.try_element_at(offsets, F.lit(-1)))["page"]


SECTION = "struct<sid:string,level:int,title:string,parent:string,derived:string,path:array<string>,block:int>"


def follows(a: Column, b: Column) -> Column:
    """Whether two numbered heading candidates count up."""
    stem = lambda n: F.regexp_replace(n, r"\d+$", "")
    last = lambda n: F.regexp_extract(n, r"(\d+)$", 1).try_cast("long")
    both = (a["kind"] == "numbered") & (b["kind"] == "numbered")
    return F.coalesce(
        both & (stem(a["number"]) == stem(b["number"])) & (last(b["number"]) == last(a["number"]) + 1), F.lit(False)
    )


def suppress_lists(cands: Column) -> Column:
    """Adjacent numbered candidates that count up are a list, not headings."""

    def body(c: Column) -> Column:
        return F.transform(
            c,
            lambda h, i: F.when(
                ~follows(F.try_element_at(c, F.when(i > 0, i).otherwise(F.size(c) + 1)), h)
                & ~follows(h, F.try_element_at(c, i + 2)),
                h,
            ),
        )

    return let(cands, body)


def section_tree(blocks: Column) -> Column:
    """Sections with ids, parents and title paths: native numbers win, other ids count children below their parent."""

    def headed(c: Column) -> Column:
        marked = F.transform(c, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("block")))
        hs = F.filter(marked, lambda m: m["h"].isNotNull())
        prefix = F.when(F.exists(c, lambda h: h["number"].isNotNull()), "u").otherwise("")

        def step(acc: Column, m: Column) -> Column:
            parents = F.filter(acc, lambda s: s["level"] < m["h"]["level"])
            parent = F.try_element_at(parents, F.lit(-1))
            siblings = F.size(F.filter(acc, lambda s: s["parent"].eqNullSafe(parent["sid"])))
            derived = F.concat_ws(".", parent["derived"], (siblings + 1).cast("string"))
            base = F.coalesce(m["h"]["number"], F.concat(prefix, derived))
            clash = F.size(F.filter(acc, lambda s: F.regexp_replace(s["sid"], r"-\d+$", "") == base))
            sid = F.when(clash == 0, base).otherwise(F.concat(base, F.lit("-"), (clash + 1).cast("string")))
            entry = F.struct(
                sid.alias("sid"),
                m["h"]["level"].alias("level"),
                m["h"]["title"].alias("title"),
                parent["sid"].alias("parent"),
                derived.alias("derived"),
                F.concat(F.coalesce(parent["path"], F.array().cast("array<string>")), F.array(m["h"]["title"])).alias("path"),
                m["block"].alias("block"),
            )
            return F.concat(acc, F.array(entry))

        return F.aggregate(hs, F.array().cast(f"array<{SECTION}>"), step)

    return let(suppress_lists(F.transform(blocks, lambda b: heading(b))), headed)


# A sentence ends after terminal punctuation, closing quotes and white space, before a capital, digit, quote or bullet;
# never after an abbreviation or a single letter.  A line break before a list item also ends one.
_ABBREV = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
SENTENCE_BREAK = (
    r"(?<=[.!?][\"”’)\]]{0,3}\s{1,8})"
    rf"(?<!(?i:(?<![\p{{L}}\p{{N}}_.])(?:{_ABBREV}|\p{{L}}))[.!?]{{1,3}}[\"”’)\]]{{0,3}}\s{{1,8}})"
    r"(?=[\p{Lu}\d\"“(\['‘\-•*])"
    r"|(?<=\n)(?=\s{0,8}(?:[-*•▪◦·]|\(?\d{1,9}[.)]|\(?[a-zA-Z][.)]|\([ivxIVX]{1,9}\))\s)"
)

UNIT = "struct<start:int,end:int,tokens:int,para:int,first:boolean,glue:boolean,mid:boolean>"


def _pieces(text: Column, base: Column) -> Column:
    """(start, end, text) of consecutive sentences; offsets cover the trimmed sentence."""
    init = F.struct(base.alias("pos"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        lead = F.length(piece) - F.length(F.regexp_replace(piece, r"^\s+", ""))
        trimmed = F.regexp_replace(piece, r"^\s+|\s+$", "")
        begin = acc["pos"] + lead
        entry = F.struct(begin.alias("start"), (begin + F.length(trimmed)).alias("end"), trimmed.alias("text"))
        out = F.when(trimmed == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(entry)))
        return F.struct((acc["pos"] + F.length(piece)).alias("pos"), out.alias("out"))

    return F.aggregate(F.split(text, SENTENCE_BREAK), init, step, lambda acc: acc["out"])


def sentence_spans(text: Column) -> Column:
    return _pieces(text, F.lit(0))


def _windows_of(start: Column, text: Column, size: int) -> Column:
    """Word windows of a run-on sentence, without overlap."""
    words = F.split(text, r"(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])")

    def step(acc: Column, w: Column) -> Column:
        has = w.rlike(WORD)
        lead = F.when(has, F.length(F.regexp_extract(w, r"^[^\p{L}\p{N}_]*", 0))).otherwise(0)
        begin = acc["pos"] + lead
        end = acc["pos"] + F.length(w)
        last = F.try_element_at(acc["out"], F.lit(-1))
        full = last.isNull() | (last["tokens"] >= size)
        fresh = F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(1).alias("tokens"))))
        grown = F.concat(
            F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), end.alias("end"), (last["tokens"] + 1).alias("tokens"))),
        )
        out = F.when(~has, acc["out"]).when(full, fresh).otherwise(grown)
        return F.struct(end.alias("pos"), out.alias("out"))

    init = F.struct(start.alias("pos"), F.array().cast("array<struct<start:int,end:int,tokens:int>>").alias("out"))
    return F.aggregate(words, init, step, lambda acc: acc["out"])


def chunk_units(text: Column, maximum: int = CHUNKING.max_tokens, paragraph: str = "\n") -> Column:
    """Paragraphs, or the sentences of an oversize paragraph, or the word windows of an oversize sentence."""
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def place(acc: Column, p: Column) -> Column:
        entry = F.struct(acc["pos"].alias("start"), p.alias("text"))
        out = F.when(F.trim(p) == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(entry)))
        return F.struct((acc["pos"] + F.length(p) + len(paragraph)).alias("pos"), out.alias("out"))

    paras = F.aggregate(F.split(text, paragraph), init, place, lambda acc: acc["out"])

    def unit(start, end, tokens, para, first, glue, mid) -> Column:
        return F.struct(
            start.cast("int").alias("start"),
            end.cast("int").alias("end"),
            tokens.cast("int").alias("tokens"),
            para.cast("int").alias("para"),
            first.alias("first"),
            glue.alias("glue"),
            mid.alias("mid"),
        )

    def of_paragraph(ps: Column):
        def expand(p: Column, i: Column) -> Column:
            glue = F.rtrim(p["text"]).endswith(":") & (i + 1 < F.size(ps))
            n = count_words(p["text"])
            whole = F.array(unit(p["start"], p["start"] + F.length(p["text"]), n, i, F.lit(True), glue, F.lit(False)))

            def split_sentence(s: Column) -> Column:
                plain = F.struct(s["start"].alias("start"), s["end"].alias("end"), count_words(s["text"]).alias("tokens"), F.lit(False).alias("mid"))
                cut = F.transform(
                    _windows_of(s["start"], s["text"], maximum),
                    lambda w, k: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["tokens"].alias("tokens"), (k > 0).alias("mid")),
                )
                return F.when(count_words(s["text"]) <= maximum, F.array(plain)).otherwise(cut)

            pieces = F.flatten(F.transform(_pieces(p["text"], p["start"]), split_sentence))
            small = let(
                pieces,
                lambda q: F.transform(
                    q,
                    lambda u, k: unit(u["start"], u["end"], u["tokens"], i, k == 0, glue & (k == F.size(q) - 1), u["mid"]),
                ),
            )
            return F.when(n <= maximum, whole).otherwise(small)

        return F.flatten(F.transform(ps, expand))

    return let(paras, of_paragraph)


def pack_units(
    units: Column,
    target: int = CHUNKING.target_tokens,
    maximum: int = CHUNKING.max_tokens,
    minimum: int = CHUNKING.min_tokens,
    overlap: int = CHUNKING.overlap_tokens,
) -> Column:
    """(start, end, mid) chunks: fill to the target, keep a lead-in with its list, carry trailing sentences when a paragraph
    is split, merge a tiny tail into its predecessor."""
    total = lambda us: F.aggregate(us, F.lit(0), lambda a, u: a + u["tokens"])
    group = "struct<start:int,end:int,mid:boolean,a:int,b:int>"
    init = F.struct(F.array().cast(f"array<{group}>").alias("out"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def body(us: Column) -> Column:
        at = lambda i: F.element_at(us, i)

        def close(acc: Column) -> Column:
            entry = F.struct(
                at(acc["a"])["start"].alias("start"),
                at(acc["b"])["end"].alias("end"),
                at(acc["a"])["mid"].alias("mid"),
                acc["a"].alias("a"),
                acc["b"].alias("b"),
            )
            return F.concat(acc["out"], F.array(entry))

        def carried(acc: Column, u: Column, i: Column) -> Column:
            """First unit of the next chunk: the longest run of whole trailing units of this paragraph that fits."""
            budget = F.least(F.lit(overlap), F.lit(maximum) - u["tokens"])

            def fits(j: Column) -> Column:
                tail = F.slice(us, j, i - j)
                return (total(tail) <= budget) & F.forall(tail, lambda x: x["para"] == u["para"])

            options = F.filter(F.sequence(acc["a"], i - 1), fits)
            return F.when(u["first"], i).otherwise(F.coalesce(F.array_min(options), i))

        def step(acc: Column, i: Column) -> Column:
            u = at(i)
            room = acc["n"] + u["tokens"] <= maximum
            joins = (acc["n"] + u["tokens"] <= target) | (room & (at(acc["b"])["glue"] | (acc["n"] < minimum)))
            first = F.struct(acc["out"].alias("out"), i.alias("a"), i.alias("b"), u["tokens"].alias("n"))
            grown = F.struct(acc["out"].alias("out"), acc["a"].alias("a"), i.alias("b"), (acc["n"] + u["tokens"]).alias("n"))
            begin = carried(acc, u, i)
            fresh = F.struct(
                close(acc).alias("out"), begin.alias("a"), i.alias("b"), total(F.slice(us, begin, i - begin + 1)).alias("n")
            )
            return F.when(acc["a"] == 0, first).otherwise(F.when(joins, grown).otherwise(fresh))

        def finish(acc: Column) -> Column:
            return let(F.when(acc["a"] == 0, acc["out"]).otherwise(close(acc)), merge_tail)

        def merge_tail(groups: Column) -> Column:
            n = F.size(groups)
            last = F.try_element_at(groups, F.lit(-1))
            prev = F.try_element_at(groups, F.when(n >= 2, n - 1).otherwise(n + 1))
            span = lambda a, b: total(F.slice(us, a, b - a + 1))
            tiny = (n >= 2) & (span(last["a"], last["b"]) < minimum) & (span(prev["a"], last["b"]) <= maximum)
            joined = F.struct(
                prev["start"].alias("start"), last["end"].alias("end"), prev["mid"].alias("mid"), prev["a"].alias("a"), last["b"].alias("b")
            )
            return F.when(F.coalesce(tiny, F.lit(False)), F.concat(F.slice(groups, 1, F.greatest(n - 2, F.lit(0))), F.array(joined))).otherwise(groups)

        return F.when(
            F.size(us) == 0, F.array().cast(f"array<{group}>")
        ).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(us), F.lit(1))), init, step, finish))

    return F.transform(
        let(units, body), lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), g["mid"].alias("mid"))
    )


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """(pos, words) windows of ``size`` words; the last one closes at the end of the text."""
    step = max(1, size - overlap)

    def body(ws: Column) -> Column:
        n = F.size(ws)
        count = F.when(n == 0, 0).otherwise(F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)) + 1)
        starts = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda k: F.struct(
                k.alias("pos"),
                (k * step).alias("first"),
                F.least(k * step + size, n).alias("last"),
                F.array_join(F.slice(ws, k * step + 1, size), " ").alias("text"),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), 0), body)


def index_header(title: Column, path: Column) -> Column:
    """`title > path` with consecutive repetitions left out."""
    parts = F.filter(F.concat(F.array(title), path), lambda p: p.isNotNull() & (p != ""))
    kept = let(
        parts,
        lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p != F.element_at(ps, F.greatest(i, F.lit(1))))),
    )
    return F.array_join(kept, " > ")


def html_text(html: Column) -> Column:
    """Plain text of a page: headings become `#` lines, blocks are separated by blank lines."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->", "")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{level}[^>]*>", "\n\n" + "#" * level + " ")
    t = F.regexp_replace(t, r"(?i)</h[1-6]>|</?(?:p|br|ul|ol|div|article|nav|footer|body|html)\b[^>]*>", "\n\n")
    t = F.regexp_replace(t, r"(?i)<li[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{2,}", "\n\n"), r"^\n+|\n+$", "")
