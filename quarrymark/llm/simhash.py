"""SimHash near-duplicates: fingerprints, links by pigeonring filtering, one component per group.

Words are split at ASCII white space and lower-cased in A-Z; a shingle is four words (``SHINGLE``) joined by spaces; each bit of the
fingerprint is the majority of that bit over the XXH64 hashes of all shingles, repeats included.  Only distinct fingerprints are
linked, so exact copies cost one row however many there are, and no row is made for a pair of copies.

Defined cases: a text of fewer than four words is one shingle; a text without words, or null, has fingerprint zero and is linked
like any other; a null id is never the smallest unless there is no other; repeated rows are rows of one component; of equal
smallest rows one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.llm.components import components
from quarrymark.llm.pigeonring import links
from quarrymark.llm.store import written

SHINGLE = 4
SEED = 42
ROWS = 500
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle + 1, 1)
    lows, highs = starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, last, CHUNK):
        parts = [joined[a:b] for a, b in zip(lows[at : at + CHUNK], highs[at : at + CHUNK], strict=True)]
        hashed = b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(hashed, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            values = [fingerprint(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(values, pa.int64())], names=["doc_id", "text_hash", "fp"]
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")
    )
    return slim.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every row; a component is named by its smallest doc_id."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(links(distinct)).withColumnRenamed("node", "fp")
    joined = distinct.join(linked, "fp")
    least = joined.groupBy("label").agg(F.min("first").alias("smallest"))
    named = joined.join(least, "label").select("fp", "smallest")
    membership = distinct.join(named, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    # read again, so that Spark can split a fingerprint with very many copies in the last join
    final = written(membership, "membership")
    return rows.join(final, "fp").select("doc_id", "text_hash", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return grouped(docs).select("doc_id", digits, "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with the columns it came with."""
    groups = grouped(docs)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    keep = groups.groupBy("component_id").agg(F.min(order).alias("k"))
    kept = keep.select(F.col("k.doc_id").alias("__keep_id"), F.col("k.text_hash").alias("__keep_hash"))
    text_hash = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    hashed = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"), text_hash.alias("hash"))
    same = (hashed["hash"] == kept["__keep_hash"]) & hashed["id"].cast("long").eqNullSafe(kept["__keep_id"])
    # rows equal in id and text meet here, and one of them stays; the join has already brought them together
    chosen = hashed.join(kept, same, "left_semi")
    place = F.row_number().over(Window.partitionBy("hash", "id").orderBy(F.lit(0)))
    return chosen.withColumn("place", place).where("place = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
