"""Sharding by histogram sort: find exact splitters by counting, then move every row once.

The sort key is (hash of the text, document id, row number), three longs compared in that order, so equal texts lie side by side
and still no group is too big to be cut.  Each round counts, over all rows, the exact bytes below a set of candidate key
boundaries; a splitter is settled when its count is within tolerance of its target, otherwise new candidates are placed between
the two nearest counted boundaries, by the smallest and largest key that were seen between them.  Only these counts (at most
``PROBES`` + 1 rows a round) reach the driver.  When all splitters stand, one exchange brings every row to its range.

A shard can be larger than a task should be.  Inside it, rows are numbered by range cells (text-hash range, then document-id
range) and by key inside a cell; offsets of the cells come from their exact row counts.

Defined cases: a null text counts as empty; a null document id sorts first; rows equal in text and id are told apart by their
row number, so they can be parted as well; an empty table gives an empty result; when one row is larger than a shard's share, the
shard that holds it exceeds its target by at most that row.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.llm.store import written

LOWEST = -(2**63)
KEYS = ("k_text", "k_id", "k_row")
PROBES = 160
ID_CELLS = 16


@dataclass
class Span:
    """What is known of the rows between two counted boundaries: bytes below it, its bytes, and the key range seen in it."""

    low: tuple
    below: int
    size: int
    keys: list[tuple[int, int]] = field(default_factory=list)


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id", row: bool = False) -> DataFrame:
    """One slim row per document: id, size, checksum and sort key; with ``row`` also the document as it is."""
    whole = F.coalesce(docs[text], F.lit(""))
    return docs.select(
        *([F.struct("*").alias("row")] if row else []),
        docs[key].alias("doc_id"),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("k_text"),
        F.coalesce(docs[key].cast("long"), F.lit(LOWEST)).alias("k_id"),
        F.monotonically_increasing_id().alias("k_row"),
    )


def _below(bound: tuple) -> Column:
    """Rows whose key is smaller than ``bound``."""
    test: Column | None = None
    for name, value in reversed(list(zip(KEYS, bound, strict=True))):
        if test is None:
            test = None if value == LOWEST else F.col(name) < value
        else:
            test = (F.col(name) < value) | ((F.col(name) == value) & test)
    return F.lit(False) if test is None else test


def _range_of(bounds: list[tuple], first: int = 0) -> Column:
    """Index of the range a row falls into, as a balanced decision tree over sorted boundaries."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(_below(bounds[mid]), _range_of(bounds[:mid], first)).otherwise(
        _range_of(bounds[mid + 1 :], first + mid + 1)
    )


def _candidates(span: Span, target: int, count: int) -> list[tuple]:
    """Boundaries strictly inside a span, around where its bytes are expected to reach ``target``."""
    for level, (least, most) in enumerate(span.keys):
        if least == most:
            continue
        prefix = tuple(k[0] for k in span.keys[:level])
        width = most - least
        guess = least + width * (target - span.below) // max(span.size, 1)
        picks = {least + 1 + (width - 1) * i // max(count - 1, 1) for i in range(count)}
        for step in range(1, count):
            near = width >> (3 * step + 2)
            picks |= {guess - near, guess + near}
        inside = {p for p in picks if least < p <= most} | {min(max(guess, least + 1), most)}
        rest = (LOWEST,) * (len(KEYS) - level - 1)
        return [(*prefix, p, *rest) for p in inside]
    return []


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple]:
    """``shards - 1`` key boundaries that part the bytes of ``rows`` evenly, each within tolerance or as near as rows allow."""
    measures = [F.sum("size").alias("size")]
    for name in KEYS:
        measures += [F.min(name).alias(f"lo_{name}"), F.max(name).alias(f"hi_{name}")]
    whole = rows.agg(*measures).first()
    if whole is None or whole["size"] is None:
        return []

    def span(low: tuple, below: int, row) -> Span:
        return Span(low, below, row["size"], [(row[f"lo_{k}"], row[f"hi_{k}"]) for k in KEYS])

    total = whole["size"]
    targets = [total * i // shards for i in range(1, shards)]
    spans = [span((LOWEST,) * len(KEYS), 0, whole)]
    open_targets = dict(enumerate(targets))
    found: dict[int, tuple] = {}
    while open_targets:
        share = max(2, PROBES // (4 * len(open_targets)))
        probes: set[tuple] = set()
        for i, target in list(open_targets.items()):
            at = max(k for k, s in enumerate(spans) if s.below <= target)
            edges = [(s.below, s.low) for s in spans[at : at + 2]]
            best = min(edges, key=lambda e: abs(e[0] - target))
            inside = _candidates(spans[at], target, share)
            if abs(best[0] - target) <= tolerance * total / shards or not inside:
                found[i] = best[1]
                del open_targets[i]
            else:
                probes |= set(inside)
        if not probes:
            continue
        bounds = sorted(probes | {s.low for s in spans[1:] if _near(s, open_targets.values(), spans)})
        counted = {r["part"]: r for r in rows.groupBy(_range_of(bounds).alias("part")).agg(*measures).collect()}
        spans, below = [], 0
        for part, low in enumerate([(LOWEST,) * len(KEYS), *bounds]):
            if part in counted:
                spans.append(span(low, below, counted[part]))
                below += counted[part]["size"]
    return [found[i] for i in range(shards - 1)]


def _near(span: Span, targets, spans: list[Span]) -> bool:
    """A boundary stays in the next count when it is an edge of a span that still holds a target."""
    at = next(k for k, s in enumerate(spans) if s is span)
    left = spans[at - 1]
    return any(left.below <= t < span.below or span.below <= t < span.below + span.size for t in targets)


def _numbered(rows: DataFrame, whole: DataFrame, shards: int, tolerance: float) -> DataFrame:
    """``whole`` with its shard and slot; all counting is done on ``rows``, the same rows with nothing but their keys."""
    bounds = splitters(rows, shards, tolerance)
    placed = rows.withColumn("shard", _range_of(bounds))
    ends = ("k_text", "k_id")
    limits = [f(n).cast("double").alias(f"{t}_{n}") for n in ends for t, f in (("lo", F.min), ("hi", F.max))]
    per_shard = {r["shard"]: r for r in placed.groupBy("shard").agg(*limits).collect()}  # one row a shard
    wide = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)

    def cell(name: str, parts: int) -> Column:
        low = F.lit(0.0)
        width = F.lit(1.0)
        for s, r in per_shard.items():
            low = F.when(F.col("shard") == s, F.lit(r[f"lo_{name}"])).otherwise(low)
            width = F.when(F.col("shard") == s, F.lit(max(r[f"hi_{name}"] - r[f"lo_{name}"], 1.0))).otherwise(width)
        share = (F.col(name).cast("double") - low) / width * parts
        return F.least(F.floor(share), F.lit(parts - 1)).cast("int")

    cells = {"c_text": cell("k_text", wide), "c_id": cell("k_id", ID_CELLS)}
    place = ["shard", "c_text", "c_id"]
    counts = placed.withColumns(cells).groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("c_text", "c_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    moved = whole.withColumn("shard", _range_of(bounds)).withColumns(cells)
    numbered = moved.withColumn("at", F.row_number().over(Window.partitionBy(*place).orderBy(*KEYS)))
    return numbered.join(offsets, place).withColumn("slot", (F.col("offset") + F.col("at") - 1).cast("long"))


def assigned(
    docs: DataFrame, shards: int = 8, tolerance: float = 0.001, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near-equal bytes, slots gapless from 0 inside each."""
    rows = written(keyed(docs, text, key), "sort-keys")
    return _numbered(rows, rows, shards, tolerance).select("doc_id", "size", "text_crc32", "shard", "slot")


def _law() -> list[Column]:
    return [
        F.col("size"),
        F.col("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard"),
        F.col("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    ]


def manifest(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """The assignment with the law it keeps; ``grown_shard`` belongs to another law and is null."""
    return assigned(docs, shards, tolerance).select("doc_id", *_law())


def sharded(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """The documents themselves, moved to their shards by one exchange, with the columns of the manifest.

    Columns that have a name of the manifest are replaced.  ``docs`` is read again after the counting and has to give the same rows
    in the same order: a written table.
    """
    rows = written(keyed(docs), "sort-keys")
    found = _numbered(rows, keyed(docs, row=True), shards, tolerance)
    added = _law()
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    return found.select(*[F.col("row")[c].alias(c) for c in own], *added)
