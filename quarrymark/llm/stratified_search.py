"""Ranked lexical search over a length-stratified index.

``build`` reads the texts twice: once for the number of documents and words, once for the shards.  A shard is a slice of an Arrow
batch of bounded size and becomes one row of Parquet: documents grouped by equal normaliser, postings by term, stratum and tf
(``stratum_index``).  Each row is a row group of its own, so that Parquet's writers and readers hold one shard and not a whole file;
document numbers and counts are 16 bits wide, as a shard has at most 32,767 documents.  ``dictionary`` holds the document frequency
of every term.  No posting is shuffled, so a frequent term is no hot key; only (term, document frequency of a shard) is, after one
entry per shard.

``search`` weighs the terms of the items, writes the items in blocks of bounded size to the shared folder, and lets every shard
answer every block.  A task keeps the best documents of the block's items over all its shards, so later shards are pruned by the
scores of earlier ones: strata are visited in the order of their bounds until a bound falls below the last place.

Scores are whole numbers: a term weighs floor(1000 ln((2N+2)/(2df+1))), an occurrence group adds that times
10^9 tf div (1000 tf + 12 m).

Defined cases: null and empty texts have no term and are no documents; an item without known terms finds nothing; every row of the
items is an item of its own, repeated rows give repeated lists; repeated documents are ranked each; a null doc_id comes after all
others; the largest 64-bit number must not be a doc_id; terms are compared by 64-bit hashes; other columns are not read.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.llm.shared_files import place
from quarrymark.llm.store import folder, written
from quarrymark.llm.stratum_index import MOST_DOCS, NO_ID, Best, Items, Shard, built
from quarrymark.llm.word_hashes import raw, slices, words_of

K = 20
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20

ARRAYS = {
    "docs": "long", "strata": "long", "stratum_docs": "short", "terms": "long", "term_docs": "short", "term_groups": "short",
    "group_tf": "int", "group_docs": "short", "postings": "short",
}
SHARD = ", ".join(f"{name} array<{kind}>" for name, kind in ARRAYS.items())


@dataclass
class Index:
    documents: int
    shards: DataFrame
    dictionary: DataFrame


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = raw(batch.column(0))
        for lo, hi in slices(at, SHARD_BYTES):
            n = np.diff(words_of(data, at[lo : hi + 1]).first)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["documents", "words"])


def _shards(batches: Iterator[pa.RecordBatch], documents: int, total: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = raw(batch.column(1))
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        for lo, hi in slices(at, SHARD_BYTES, MOST_DOCS):
            shard = built(words_of(data, at[lo : hi + 1]), ids[lo:hi], documents, total)
            if shard is not None:
                kinds = {"long": np.int64, "int": np.int32, "short": np.int16}
                arrays = [pa.array([shard[n].astype(kinds[k], copy=False)]) for n, k in ARRAYS.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(ARRAYS))


def build(docs: DataFrame) -> Index:
    text = F.col("text").cast("string").alias("text")
    sizes = docs.select(text).mapInArrow(_counted, "documents long, words long")
    counted = sizes.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    documents, total = counted
    slim = docs.select(F.col("doc_id").cast("long"), text)
    shards = written(slim.mapInArrow(lambda b: _shards(b, documents, total), SHARD), "strata", group_rows=1)
    each = shards.select(F.explode(F.arrays_zip("terms", "term_docs")).alias("t"))
    df = each.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.term_docs").alias("df"))
    return Index(documents, shards, written(df, "dictionary"))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = raw(batch.column(1))
        for lo, hi in slices(at, BLOCK_BYTES):
            words = words_of(data, at[lo : hi + 1])
            row = np.repeat(np.arange(hi - lo), np.diff(words.first))
            terms, term = np.unique(words.hash, return_inverse=True)
            key, times = np.unique(row * max(len(terms), 1) + term, return_counts=True)
            row, term = key // max(len(terms), 1), key % max(len(terms), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row + lo)), pa.array(terms[term].view(np.int64)), pa.array(times.astype(np.int64))],
                names=["item", "term", "times"],
            )


def _stored(batches: Iterator[pa.RecordBatch], target: str, documents: int) -> Iterator[pa.RecordBatch]:
    """One file for each block of items; rows come sorted by block and item, a repeated task writes files of its own."""

    def file(block: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        item, term, times, df = (np.concatenate([r.column(i).to_numpy() for r in rows]) for i in range(1, 5))
        ids, first = np.unique(item, return_index=True)
        logs = {int(d): math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in np.unique(df)}
        weight = times * np.array([logs[d] for d in df.tolist()], dtype=np.int64)
        packed = io.BytesIO()
        np.savez(packed, ids=ids, first=np.append(first, len(item)), term=term.view(np.uint64), weight=weight)
        uri = f"{target}/block-{block}-{uuid.uuid4().hex}.npz"
        system, path = place(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(packed.getvalue())
        return pa.RecordBatch.from_arrays([pa.array([uri])], names=["file"])

    now, held = None, []
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(blocks, prepend=-1) != 0), len(blocks))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if blocks[a] != now:
                if held:
                    yield file(now, held)
                now, held = int(blocks[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield file(now, held)


@lru_cache(maxsize=1)
def _block(uri: str) -> tuple[np.ndarray, Items]:
    system, path = place(uri)
    with system.open_input_file(path) as f:
        data = np.load(io.BytesIO(f.read()))
    return data["ids"], Items(data["first"], data["term"], data["weight"])


def _searched(batches: Iterator[pa.RecordBatch], uri: str, k: int) -> Iterator[pa.RecordBatch]:
    ids, items = _block(uri)
    best = Best(len(ids), k)
    for batch in batches:
        for i in range(batch.num_rows):
            parts = {n: batch.column(j).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for j, n in enumerate(ARRAYS)}
            Shard(parts).search(items, best)
    row, column = np.nonzero(best.score > 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[row]), pa.array(best.doc[row, column]), pa.array(best.score[row, column])], names=["item", "doc_id", "score"]
    )


def search(index: Index, items: DataFrame, k: int = K, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    size = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit("")))
    numbered = written(
        items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("item_id"), F.col(text).cast("string").alias("text")),
        "items",
    )
    blocks = -(-(numbered.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // BLOCK_BYTES)
    if not blocks or not index.documents:
        return _ranked(numbered.limit(0).select("item", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")), numbered, k)
    terms = numbered.select("item", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _item_terms, "item long, term long, times long"
    )
    weighed = terms.join(index.dictionary, "term").select(
        F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item", "term", "times", "df"
    )
    target = folder(items.sparkSession, "item-blocks")
    documents = index.documents
    dealt = weighed.repartition(blocks, "block").sortWithinPartitions("block", "item", "term")
    names = dealt.mapInArrow(lambda b: _stored(b, target, documents), "file string")
    files = sorted(r["file"] for r in names.collect())  # one name a block
    found = [
        index.shards.mapInArrow(lambda b, uri=uri: _searched(b, uri, k), "item long, doc_id long, score long") for uri in files
    ]
    none = index.shards.limit(0).select(*(F.lit(0).cast("long").alias(c) for c in ("item", "doc_id", "score")))
    return _ranked(reduce(DataFrame.unionByName, found, none), numbered, k)


def _ranked(found: DataFrame, numbered: DataFrame, k: int) -> DataFrame:
    place_ = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    top = found.withColumn("rank", place_).where(F.col("rank") <= k)
    return numbered.select("item", "item_id").join(top, "item").select(
        "item_id", "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score"
    )


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build(docs), items)
