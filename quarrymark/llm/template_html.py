"""HTML extraction by template deduction from equivalence classes.

Every page is parsed once into element paths and text blocks, which are written; all later steps read these.  Tokens of a page are
its element paths and its texts.  Over all pages of a host, tokens with the same occurrence vector (the same count on every page)
form an equivalence class.  A vector is never stored: each page has two fixed pseudo-random numbers, and the sums of count times
number over the pages are equal exactly when the vectors are (up to a negligible chance), so classes come from sums that are
combined before they are shuffled, however many pages a host has.

A class is valid as far as its members keep their order: on every page the occurrences of a class are put in a row, and a member
counts only if it has the same place in every round of every page (smallest and largest place are combined per host).  Valid
classes nest along element paths, since a path is opened on every page its inner paths are: a text that is a valid member of the
class of the page or of any element around it is a constant of the template.  What is left are slots.  Inside an ``article`` or
``main``, constants go only at the edges, and headings stay; elsewhere they go.  A slot outside ``article`` and ``main`` whose
text is mostly links over the whole host, and the same links on several pages, is a menu.  Elements with another purpose (by
element name, role or class words) go too.  ``article`` and ``main`` bound the text when they hold at least half of what is left.

Only the few tokens to be dropped are joined back to the pages, by host; Spark broadcasts them when the written table is small and
splits a hot host otherwise.

Defined cases: null html is an empty page with empty text, a null or odd url belongs to the host without a name; a host with fewer
than ``least_pages`` pages has no template, its pages go by element roles alone; repeated rows are extracted each; unclosed, stray
and broken tags are read as browsers do in the common cases; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymark.llm.page_blocks import Block, parse
from quarrymark.llm.store import temporary, written

SUPPORT = 0.5
LEAST_PAGES = 8
MENU_LINKS = 0.6
RECURRING = 0.5
BOUND = 0.5
HELD = 100_000
ROWS = 200
PAGE = 0
MAIN = 1
MENU, CONSTANT = 0, 1

PARSED = (
    "page_id long, url string, host string, mark long, paths array<string>, events array<int>, texts array<string>, "
    "text_path array<int>, linked array<int>, chrome array<boolean>, main array<boolean>"
)
TOKENS = (
    "host string, payload long, token long, at long, around array<long>, n long, total long, sum_a long, sum_b long, chars long, linked long"
)
PLACES = "host string, token long, low int, high int"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def path_token(path: str) -> int:
    return _signed(xxhash.xxh64_intdigest(path))


def text_token(path: str, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{path}\n{text}"))


def _around(path: str) -> list[int]:
    """The page, the element of a path and all elements around it; MAIN for those of an article."""
    parts = path.split(">")
    inside = any(label.split(".")[0] in ("article", "main") for label in parts)
    return [PAGE] + [MAIN] * inside + [path_token(">".join(parts[: i + 1])) for i in range(min(1, len(parts) - 1), len(parts))]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings, ints, flags = pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_())
    kinds = [pa.int64(), strings, ints, strings, ints, ints, flags, flags]
    names = [part.split()[0] for part in PARSED.split(", ")]
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            rows = []
            for html in part.column(3).to_pylist():
                blocks, events = parse(html)
                number: dict[str, int] = {}
                steps = [number.setdefault(e, len(number)) if isinstance(e, str) else ~e for e in events]
                at = [number.setdefault(b.path, len(number)) for b in blocks]
                texts = [b.text for b in blocks]
                mark = _signed(xxhash.xxh64_intdigest("\n".join(texts)))
                rows.append(
                    (mark, list(number), steps, texts, at, [b.linked for b in blocks], [b.chrome for b in blocks], [b.main for b in blocks])
                )
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *columns], names=names)


def parsed(pages: DataFrame) -> DataFrame:
    """Blocks and events of every page; events are numbers of paths that open, or the complement of a block's number."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    return pages.select(F.col("page_id").cast("long"), "url", host, html).mapInArrow(_parsed, PARSED)


def _page_tokens(paths: list[str], events: list[int], texts: list[str], at: list[int], linked: list[int]) -> dict[int, list]:
    """token -> [path token it stands in, count, characters, linked characters, path]; PAGE counts the page itself."""
    tokens: dict[int, list] = {PAGE: [PAGE, 1, 0, 0, ""]}
    known = [path_token(p) for p in paths]
    for event in events:
        if event >= 0:
            tokens.setdefault(known[event], [PAGE, 0, 0, 0, paths[event]])[1] += 1
    for text, where, links in zip(texts, at, linked, strict=True):
        slot = tokens.setdefault(known[where], [PAGE, 1, 0, 0, paths[where]])
        slot[2] += len(text)
        slot[3] += links
        t = tokens.setdefault(text_token(paths[where], text), [known[where], 0, 0, 0, None])
        t[1] += 1
        t[2] += len(text)
        t[3] += links
    return tokens


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token sums of the pages a task reads, combined up to HELD tokens at a time; those of a copied page under its payload, once."""
    held: dict[tuple[str, int, int], list] = {}
    counted: set[tuple[str, int]] = set()

    def out() -> pa.RecordBatch:
        rows = [(*key, *sums) for key, sums in held.items()]
        held.clear()
        counted.clear()  # a copy counted again is taken as one by the largest sum
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())] + [pa.int64()] * 6
        names = [part.split()[0] for part in TOKENS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            for host, mark, copied, *page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                payload = mark if copied else 0
                if payload:
                    if (host, payload) in counted:
                        continue
                    counted.add((host, payload))
                a, b = mark & 0x7FFFFFFF, (mark >> 32) & 0x7FFFFFFF
                for token, (at, count, chars, linked, path) in _page_tokens(*page).items():
                    sums = held.get((host, payload, token))
                    if sums is None:
                        sums = held[host, payload, token] = [at, None if path is None else _around(path), 0, 0, 0, 0, 0, 0]
                    sums[2] += 1
                    sums[3] += count
                    sums[4] += count * a
                    sums[5] += count * b
                    sums[6] += chars
                    sums[7] += linked
            if len(held) >= HELD:
                yield out()
    if held:
        yield out()


def places(sequence: list[int], members: dict[int, int], sizes: dict[int, int]) -> Iterator[tuple[int, int]]:
    """(token, place in its round) of all occurrences of class members on a page."""
    seen: dict[int, int] = {}
    for token in sequence:
        kind = members.get(token)
        if kind is not None:
            at = seen.get(kind, 0)
            seen[kind] = at + 1
            yield token, at % sizes[kind]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest and largest place of every class member over the pages a task reads."""
    held: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            for host, paths, events, texts, at, classes in zip(*(c.to_pylist() for c in part.columns), strict=True):
                members = {c["token"]: c["class"] for c in classes}
                sizes: dict[int, int] = {}
                for kind in members.values():
                    sizes[kind] = sizes.get(kind, 0) + 1
                known = [path_token(p) for p in paths]
                sequence = [known[e] if e >= 0 else text_token(paths[at[~e]], texts[~e]) for e in events]
                for token, place in places(sequence, members, sizes):
                    span = held.setdefault((host, token), [place, place])
                    span[0], span[1] = min(span[0], place), max(span[1], place)
    if held:
        rows = [(*key, *span) for key, span in held.items()]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
        names = [part.split()[0] for part in PLACES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def token_sums(pages: DataFrame) -> DataFrame:
    """Sums of every token of every host; pages whose text is the same count once."""
    twice = pages.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    copied = written(twice.select("host", "mark", F.lit(True).alias("copied")), "copies")
    sums = ("n", "total", "sum_a", "sum_b", "chars", "linked")
    kinds = [F.first("at").alias("at"), F.first("around").alias("around")]
    once = [F.when(F.col("payload") == 0, F.sum(c)).otherwise(F.max(c)).alias(c) for c in sums]
    slim = pages.join(copied, ["host", "mark"], "left").select(
        "host", "mark", F.coalesce("copied", F.lit(False)).alias("copied"), "paths", "events", "texts", "text_path", "linked"
    )
    singles = slim.mapInArrow(_counted, TOKENS).groupBy("host", "payload", "token").agg(*kinds, *once)
    return singles.groupBy("host", "token").agg(*kinds, *[F.sum(c).alias(c) for c in sums])


def templates(pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, drop): what the template of each host drops, as (kind, token): menu slots by path, constants by text."""
    tokens = written(token_sums(pages).where((F.col("n") > 1) | (F.col("token") == PAGE)), "tokens")
    per_host = tokens.where(F.col("token") == PAGE).select("host", F.col("n").alias("pages"))
    common = tokens.join(per_host, "host").where((F.col("n") >= least_pages) & (F.col("n") >= support * F.col("pages")))
    supported = written(common.withColumn("class", F.xxhash64("n", "total", "sum_a", "sum_b")), "classes")
    paths = supported.where(F.col("around").isNotNull())
    texts = supported.where(F.col("around").isNull())
    outer = paths.select("host", F.col("token").alias("above"), F.col("class").alias("outer"))
    ways = paths.select("host", F.col("token").alias("at"), F.explode("around").alias("above"))
    enclosing = ways.join(outer, ["host", "above"]).select("host", "at", F.col("outer").alias("class")).distinct()
    constants = written(texts.join(enclosing, ["host", "at", "class"], "left_semi").select("host", "token", "class"), "constants")

    # the classes with constants, put to the test of their order; a host has at most pages' length / support of them
    tested = supported.join(constants.select("host", "class").distinct(), ["host", "class"], "left_semi").where(F.col("token") != PAGE)
    classes = written(tested.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("classes")), "tested")
    sequences = pages.select("host", "paths", "events", "texts", "text_path").join(classes, "host").mapInArrow(_placed, PLACES)
    kept = sequences.groupBy("host", "token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high")
    valid = constants.join(kept, ["host", "token"], "left_semi").select("host", F.lit(CONSTANT).alias("kind"), "token")

    again = tokens.where(F.col("around").isNull()).groupBy("host", F.col("at").alias("token")).agg(F.sum("linked").alias("again"))
    lists = paths.where((F.col("linked") > MENU_LINKS * F.col("chars")) & ~F.array_contains("around", MAIN))
    repeated = lists.join(again, ["host", "token"]).where(F.col("again") > RECURRING * F.col("linked"))
    drop = valid.union(repeated.select("host", F.lit(MENU), "token"))
    return drop.groupBy("host").agg(F.collect_list(F.struct("kind", "token")).alias("drop"))  # bounded: every token has support


def main_text(blocks: list[Block], menus: frozenset[int] = frozenset(), constants: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given what its host's template drops."""
    shown = [b for b in blocks if not b.chrome and not (menus and path_token(b.path) in menus)]
    fixed = [bool(constants) and text_token(b.path, b.text) in constants for b in shown]
    inner = [i for i, b in enumerate(shown) if b.main]
    edge = set()
    for side in (inner, inner[::-1]):
        for i in side:
            if not fixed[i] or shown[i].heading:
                break
            edge.add(i)
    kept = [b for i, b in enumerate(shown) if i not in edge and (b.main or not fixed[i])]
    held = sum(len(b.text) for b in kept if b.main)
    if held and held >= BOUND * sum(len(b.text) for b in kept):
        kept = [b for b in kept if b.main]
    return "\n\n".join(b.text for b in kept)


def article(html: str) -> str:
    """The main text of a page without a template."""
    return main_text(parse(html)[0])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            out = []
            for paths, texts, at, chrome, main, drop in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True):
                blocks = [Block(paths[a], t, 0, c, m, 0, False) for a, t, c, m in zip(at, texts, chrome, main, strict=True)]
                by_kind = [frozenset(d["token"] for d in drop or () if d["kind"] == kind) for kind in (MENU, CONSTANT)]
                out.append(main_text(blocks, *by_kind))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extracted(pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    read = written(parsed(pages), "pages", codec="zstd")
    with temporary(pages.sparkSession):
        known = written(templates(read, support, least_pages), "templates", up=1)
    joined = read.join(known, "host", "left").select("page_id", "url", "paths", "texts", "text_path", "chrome", "main", "drop")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
