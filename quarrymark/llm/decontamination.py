"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of consecutive documents of bounded size.  Its words become numbers of the benchmark's vocabulary; a word that
no item has can lie in no occurrence, so it only separates passages, and passages shorter than the shortest window are left out:
what remains holds every possible occurrence.  The index over these numbers answers all test phrases at once by backward search
through wavelet-tree ranks, finds the occurrences by sampled suffix positions, and their word ranges are merged to removal spans.

A window is ``WINDOW`` consecutive item words; an item with fewer words is one window.  Nothing is shuffled and nothing of the
corpus leaves its task.  Benchmark items are prepared by tasks in parts of bounded size, each one file in the shared folder; a task
holds one part at a time, so the benchmark may be larger than memory.

Defined cases: null and empty texts have no words; an item without words has no window; items of equal text are all reported;
repeated rows are reported each; a document longer than a shard is a shard of its own; without items nothing is hit; other
columns are passed through by ``cleaned`` and not read by ``report``.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymark.llm.fm_index import FMIndex
from quarrymark.llm.shared_files import place
from quarrymark.llm.store import folder
from quarrymark.llm.word_hashes import Words, raw, slices, words_of

WINDOW = 10
SHARD_BYTES = 8 << 20
PART_BYTES = 32 << 20
FILTER_BITS = 22

REPORT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


@dataclass
class Phrases:
    """Windows of one part of the benchmark: vocabulary, windows by length, and the items of each window."""

    ids: list[str]
    vocabulary: np.ndarray
    seen: np.ndarray
    shortest: int
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (window matrix, first entry of each window, items)


def _windows(texts: list[str], window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every window length, a matrix of word hashes and the row number of the item each line comes from."""
    column = pa.array(texts, pa.large_string())
    words = words_of(*raw(column))
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i in range(len(texts)):
        h = words.hash[words.first[i] : words.first[i + 1]]
        if len(h):
            size = min(window, len(h))
            found.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(h, size), i))
    return {
        size: (np.concatenate([m for m, _ in rows]), np.concatenate([np.full(len(m), i) for m, i in rows]))
        for size, rows in found.items()
    }


def _stored(ids: list[str], texts: list[str], window: int, uri: str) -> None:
    data = {"ids": np.array(ids)}
    for length, (matrix, owner) in _windows(texts, window).items():
        data[f"w{length}"], data[f"i{length}"] = matrix, owner
    packed = io.BytesIO()
    np.savez(packed, **data)
    system, path = place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(packed.getvalue())


def _prepared(batches: Iterator[pa.RecordBatch], window: int, target: str) -> Iterator[pa.RecordBatch]:
    """One file for each run of rows of the same part; a repeated task writes files of its own."""

    def file(part: int, ids: list[str], texts: list[str]) -> pa.RecordBatch:
        uri = f"{target}/part-{part}-{uuid.uuid4().hex}.npz"
        _stored(ids, texts, window, uri)
        return pa.RecordBatch.from_arrays([pa.array([uri])], names=["file"])

    now, ids, texts = None, [], []
    for batch in batches:
        for part, id_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                if ids:
                    yield file(now, ids, texts)
                now, ids, texts = part, [], []
            ids.append(id_ if id_ is not None else "")
            texts.append(text)
    if ids:
        yield file(now, ids, texts)


def prepare(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> list[str]:
    """Write the windows of all items from tasks, a bounded part at a time, and return the files."""
    rows = items.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    parts = -(-size // PART_BYTES)
    if not parts:
        return []
    target = folder(items.sparkSession, "phrases")
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts)).alias("part")
    dealt = rows.select(part, "id", "text").repartition(parts, "part").sortWithinPartitions("part")
    written = dealt.mapInArrow(lambda batches: _prepared(batches, window, target), "file string")
    return sorted(r["file"] for r in written.collect())  # one name a part


@lru_cache(maxsize=1)
def _load(uri: str) -> Phrases:
    system, path = place(uri)
    with system.open_input_file(path) as f:
        data = dict(np.load(io.BytesIO(f.read())))
    lengths = sorted(int(k[1:]) for k in data if k[0] == "w")
    vocabulary = np.unique(np.concatenate([data[f"w{n}"].ravel() for n in lengths] or [np.zeros(0, np.uint64)]))
    seen = np.zeros(1 << FILTER_BITS, dtype=bool)
    seen[vocabulary >> np.uint64(64 - FILTER_BITS)] = True
    windows = []
    for n in lengths:
        numbers = np.searchsorted(vocabulary, data[f"w{n}"]) + 1
        distinct, which = np.unique(numbers, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        first = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))
        windows.append((distinct, first, data[f"i{n}"][order]))
    return Phrases([str(x) for x in data["ids"]], vocabulary, seen, min(lengths, default=0), windows)


def _passages(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the passages that can hold a window, 0 after each; and the word each symbol stands for (-1 for a 0)."""
    n = len(words.hash)
    number = np.zeros(n + 1, dtype=np.int64)
    maybe = np.flatnonzero(phrases.seen[words.hash >> np.uint64(64 - FILTER_BITS)])
    at = np.minimum(np.searchsorted(phrases.vocabulary, words.hash[maybe]), len(phrases.vocabulary) - 1)
    number[maybe] = np.where(phrases.vocabulary[at] == words.hash[maybe], at + 1, 0)
    known = number > 0
    opens = np.zeros(n + 1, dtype=bool)
    opens[words.first] = True
    begin = np.flatnonzero(known & (opens | np.concatenate(([True], ~known[:-1]))))
    closes = ~known
    closes[words.first] = True
    ends = np.flatnonzero(closes)
    end = ends[np.searchsorted(ends, begin, side="right")] if len(begin) else begin
    fits = end - begin >= phrases.shortest
    begin, end = begin[fits], end[fits]
    sizes = end - begin + 1
    total = int(sizes.sum())
    starts = np.cumsum(sizes) - sizes
    word = np.arange(total) - np.repeat(starts - begin, sizes)
    word[starts + sizes - 1] = -1
    return np.where(word >= 0, number[word], 0), word


def _find(words: Words, files: list[str]) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are hit, and the items found in each text."""
    n = len(words.hash)
    change = np.zeros(n + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
    for uri in files if n else []:
        phrases = _load(uri)
        if not phrases.windows:
            continue
        symbols, word = _passages(words, phrases)
        if not len(symbols):
            continue
        index = FMIndex(symbols, len(phrases.vocabulary))
        for matrix, first, owner in phrases.windows:
            which, low, high = index.search(matrix)
            count = high - low
            if not len(which):
                continue
            rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - low, count)
            begin = word[index.locate(rows)]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + matrix.shape[1], -1)
            text = np.searchsorted(words.first, begin, side="right") - 1
            pairs = np.unique(np.stack((text, np.repeat(which, count))), axis=1)
            for t, w in pairs.T:
                items[t].update(phrases.ids[i] for i in owner[first[w] : first[w + 1]])
    return np.cumsum(change)[:n] > 0, items


def _spans(words: Words, hit: np.ndarray, text: int) -> list[tuple[int, int]]:
    """Merged runs of hit words of one text, as byte ranges from the shard's start."""
    a, b = words.first[text], words.first[text + 1]
    mine = np.concatenate(([False], hit[a:b], [False]))
    turns = np.flatnonzero(mine[1:] != mine[:-1])
    return [(int(words.start[a + s]), int(words.end[a + e - 1])) for s, e in zip(turns[::2], turns[1::2], strict=True)]


def _reported(batches: Iterator[pa.RecordBatch], files: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = raw(batch.column(1))
        for lo, hi in slices(at, SHARD_BYTES):
            part = at[lo : hi + 1]
            words = words_of(data, part)
            hit, items = _find(words, files)
            total = np.concatenate(([0], np.cumsum(hit)))
            spans = [
                [{"start": s - int(part[i] - part[0]), "end": e - int(part[i] - part[0])} for s, e in _spans(words, hit, i)]
                if items[i]
                else []
                for i in range(hi - lo)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(words.first)),
                    pa.array(total[words.first[1:]] - total[words.first[:-1]]),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): spans are UTF-8 byte ranges of the text."""
    files = prepare(items, window)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(lambda batches: _reported(batches, files), REPORT)


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The report with its item list as count and checksum."""
    joined = F.array_join("items", ",")
    return report(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _cut(text: bytes, spans: list[tuple[int, int]], base: int) -> bytes:
    """A text without its spans, which count from ``base`` before it."""
    pieces, done = [], 0
    for start, end in spans:
        pieces.append(text[done : start - base])
        done = end - base
    return b" ".join([*pieces, text[done:]])


def _cut_until_clean(texts: dict[int, bytes], files: list[str]) -> dict[int, bool]:
    """Cut texts again, all of them in one index a round, until joined ends form no new occurrence; whether words are left."""
    left: dict[int, bool] = {}
    open_ = list(texts)
    while open_:
        column = pa.array([texts[i] for i in open_], pa.large_binary()).view(pa.large_string())
        data, at = raw(column)
        again = []
        for lo, hi in slices(at, SHARD_BYTES):
            words = words_of(data, at[lo : hi + 1])
            hit, items = _find(words, files)
            for j, i in enumerate(open_[lo:hi]):
                if items[j]:
                    texts[i] = _cut(texts[i], _spans(words, hit, j), int(at[lo + j] - at[lo]))
                    again.append(i)
                else:
                    left[i] = bool(words.first[j + 1] > words.first[j])
        open_ = again
    return left


def _cleaned(batches: Iterator[pa.RecordBatch], files: list[str], text_at: int, size_at: int | None):
    for batch in batches:
        data, at = raw(batch.column(text_at))
        for lo, hi in slices(at, SHARD_BYTES):
            part = at[lo : hi + 1]
            words = words_of(data, part)
            hit, items = _find(words, files)
            rows = batch.slice(lo, hi - lo)
            dirty = [i for i, x in enumerate(items) if x]
            if not dirty:
                yield rows
                continue
            cut = {}
            for i in dirty:
                whole = data[part[i] : part[i + 1]].tobytes()
                cut[i] = _cut(whole, _spans(words, hit, i), int(part[i] - part[0]))
            keep = np.ones(hi - lo, dtype=bool)
            for i, some in _cut_until_clean(cut, files).items():
                keep[i] = some
            texts = rows.column(text_at).to_pylist()
            sizes = rows.column(size_at).to_pylist() if size_at is not None else None
            for i, text in cut.items():
                texts[i] = text.decode()
                if sizes is not None:
                    sizes[i] = len(texts[i])
            columns = list(rows.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if sizes is not None:
                columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without benchmark passages; one that consists of nothing else goes.  ``n_chars`` follows the text."""
    files = prepare(items, window)
    text_at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(lambda batches: _cleaned(batches, files, text_at, size_at), docs.schema)
