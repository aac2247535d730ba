"""Pairs of 64-bit fingerprints within a Hamming distance, found by pigeonring filtering.

The 64 bits are cut into five segments on a ring.  If two fingerprints differ in at most four bits, then from some segment on every
chain of l consecutive segments differs in at most l * 4 / 5 bits: the first segment is equal, the first two differ in one bit at
most, and so on.  Chains of two segments are looked up: a fingerprint is filed under its own two segments (26 bits), and under each
variant with one set bit of the second segment cleared; two fingerprints that satisfy the chain share a file, one of them under its
own key.  This prunes all other pairs; those that share a file get the full Hamming check.

Inside a file only the edges of a spanning forest are kept, so a large group of near copies yields a number of rows in proportion
to its members.  A file in which even comparing would be too much work is answered without pairs: two fingerprints within four bits
share a point that is at most two bits from each, so every member names all its points at distance two or less, and members that
name the same point are linked through the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymark.llm.store import written

DISTANCE = 4
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = (51, 38, 25, 12, 0)
FILE_WORK = 1 << 27
FILE_ROWS = 1 << 21
CHUNK = 1 << 22

FILED = "bucket long, variant boolean, fp long"
FOUND = "dense boolean, a long, b long"
POINTS = "point long, fp long"


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(len(WIDTHS)):
            after = (start + 1) % len(WIDTHS)
            first = (fp >> np.uint64(SHIFTS[start])) & np.uint64((1 << WIDTHS[start]) - 1)
            second = (fp >> np.uint64(SHIFTS[after])) & np.uint64((1 << WIDTHS[after]) - 1)
            key = (np.uint64(start) << np.uint64(26)) | (first << np.uint64(13)) | second
            keys, variants, owners = [key], [np.zeros(len(fp), bool)], [fp]
            for bit in range(WIDTHS[after]):
                has = (second >> np.uint64(bit)) & np.uint64(1) == 1
                keys.append(key[has] ^ np.uint64(1 << bit))
                variants.append(np.ones(int(has.sum()), bool))
                owners.append(fp[has])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.concatenate(variants)),
                    pa.array(np.concatenate(owners).view(np.int64)),
                ],
                names=["bucket", "variant", "fp"],
            )


def forest(own: np.ndarray, variants: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest over the links own-own and own-variant within DISTANCE."""
    nodes = np.concatenate((own, variants))
    is_own = np.arange(len(nodes)) < len(own)
    fresh = np.ones(len(nodes), bool)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for seed in range(len(own)):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        front = np.array([seed])
        while len(front):
            grown: list[np.ndarray] = []
            for part, reach in ((front[is_own[front]], fresh), (front[~is_own[front]], fresh & is_own)):
                for lo in range(0, len(part), 1024):
                    some = part[lo : lo + 1024]
                    for block in np.array_split(np.flatnonzero(reach & fresh), max(1, len(nodes) * len(some) // CHUNK)):
                        near = np.bitwise_count(nodes[some][:, None] ^ nodes[block][None, :]) <= DISTANCE
                        hit = near.any(axis=0)
                        new = block[hit]
                        if len(new):
                            edges.append((nodes[some[near[:, hit].argmax(axis=0)]], nodes[new]))
                            fresh[new] = False
                            grown.append(new)
            front = np.concatenate(grown) if grown else np.zeros(0, np.int64)
    return edges


class Files:
    """Reads rows sorted by (bucket, variant) and answers one bucket after the other."""

    def __init__(self) -> None:
        self.bucket: int | None = None
        self.own: list[np.ndarray] = []
        self.variants: list[np.ndarray] = []
        self.rows = 0
        self.dense = False

    def _out(self, dense: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), dense)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
            names=["dense", "a", "b"],
        )

    def close(self) -> Iterator[pa.RecordBatch]:
        """Answer the open bucket."""
        if self.bucket is not None and self.own:
            own = np.concatenate(self.own)
            variants = np.concatenate(self.variants) if self.variants else own[:0]
            if self.dense or len(own) * (len(own) + len(variants)) > FILE_WORK:
                members = np.concatenate((own, variants))
                yield self._out(True, members, members)
            elif len(own) + len(variants) > 1:
                edges = forest(own, variants)
                if edges:
                    yield self._out(False, *(np.concatenate(x) for x in zip(*edges, strict=True)))
        self.bucket, self.own, self.variants, self.rows, self.dense = None, [], [], 0, False

    def add(self, bucket: int, own: np.ndarray, variants: np.ndarray) -> Iterator[pa.RecordBatch]:
        if bucket != self.bucket:
            yield from self.close()
            self.bucket = bucket
        if len(own):
            self.own.append(own)
        if len(variants) and self.own:  # a file without an own fingerprint has no pair
            self.variants.append(variants)
        self.rows += len(own) + len(variants)
        if self.own and self.rows > FILE_ROWS:
            members = np.concatenate((*self.own, *self.variants))
            yield self._out(True, members, members)
            self.own, self.variants, self.rows, self.dense = [members[:1]], [], 0, True


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = Files()
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy(zero_copy_only=False)
        variant = batch.column(1).to_numpy(zero_copy_only=False)
        fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        last = np.concatenate((first[1:], [len(bucket)]))
        # most files hold one row and are done with at once; the first and the last may go on in another batch
        live = (last - first > 1) & ~variant[first]
        live[[0, -1]] = True
        for lo, hi in zip(first[live].tolist(), last[live].tolist(), strict=True):
            v = variant[lo:hi]
            yield from files.add(int(bucket[lo]), fp[lo:hi][~v], fp[lo:hi][v])
    yield from files.close()


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = [np.uint64(1 << i) for i in range(64)]
    masks = np.array([np.uint64(0), *bits, *(a | b for a, b in combinations(bits, 2))], dtype=np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(fp), 256):
            some = fp[lo : lo + 256]
            points = (some[:, None] ^ masks[None, :]).ravel()
            owners = np.repeat(some, len(masks))
            yield pa.RecordBatch.from_arrays(
                [pa.array(points.view(np.int64)), pa.array(owners.view(np.int64))], names=["point", "fp"]
            )


def _through_points(members: DataFrame) -> DataFrame:
    named = members.mapInArrow(_points, POINTS)
    least = named.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly what fingerprints (column ``fp``, distinct) within DISTANCE connect."""
    filed = fingerprints.select("fp").mapInArrow(_filed, FILED)
    sorted_files = filed.repartition("bucket").sortWithinPartitions("bucket", "variant")
    found = written(sorted_files.mapInArrow(_linked, FOUND), "links")
    edges = found.where("NOT dense").select("a", "b")
    dense = found.where("dense").select(F.col("a").alias("fp")).distinct()
    return edges if dense.isEmpty() else edges.union(_through_points(dense))
