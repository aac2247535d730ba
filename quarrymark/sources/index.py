"""A lexical index on disk, and exact search that skips blocks.

Texts are tokenised once, into one row of counted terms per document; everything else is derived from that table.  Documents of
similar length form ranges of bounded size, and whole documents are dealt out by range: postings are grouped inside a range and never
shuffled.  The postings of a term in a range are one block with the largest part that any of its documents can take of the term's
idf.  Every file has the blocks of some ranges in the order of (term, range), so a query's terms touch few row groups, and the blocks
of a frequent term are spread over all files.

``search`` adds up, for every query and range, the largest parts of the query's terms: no document of the range scores more.  It
scores the most promising ranges first, takes the k-th best score found there, and then reads only blocks of ranges that can still
reach it.  What is skipped cannot be among the best k, so the result is that of a full scan.

The folder is named after the content and the options, so an unchanged corpus finds its index again and a changed one does not
find a stale one.  The manifest, with the number of rows and an order-free checksum of every table, is written last: a folder
without it was not finished and counts as absent.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymark.config import RETRIEVAL
from quarrymark.operators import lexical
from quarrymark.operators.rank import top_k
from quarrymark.session import shared_folder

VERSION = 2
TABLES = ("documents", "terms", "blocks")
RANGE_DOCS = 128
PART_POSTINGS = 1_000_000
COUNTS = "terms array<string>, tfs array<long>"
SEED_RANGES = 3
ROUNDING = 1e-6


@dataclass(frozen=True)
class Options:
    k1: float = RETRIEVAL.k1
    b: float = RETRIEVAL.b

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def _checksum(df: DataFrame) -> tuple[int, str]:
    """Rows and order-free digest: hashes of the rows, cut in two, are summed in every task."""
    h = F.xxhash64(*df.columns)
    halves = F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))
    n, high, low = df.agg(F.count(F.lit(1)), *[F.coalesce(x.cast("decimal(38,0)"), F.lit(0)) for x in halves]).first()
    return n, f"{int(high):x}-{int(low):x}"


def corpus_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> str:
    """Order-free digest of all (key, text) rows."""
    h = F.sha2(F.concat_ws("\t", F.col(key).cast("string"), F.col(text)), 256)
    part = lambda a: F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    row = docs.agg(F.count(F.lit(1)).alias("n"), *[part(a).alias(f"p{a}") for a in (1, 13, 25, 37)]).first()
    return hashlib.sha256("|".join(str(v) for v in row).encode()).hexdigest()


def files_digest(spark: SparkSession, folder: str) -> str:
    """Digest of the names, sizes and times of the files of a table: a changed table has another one, and no text is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    files = []
    while listed.hasNext():
        f = listed.next()
        files.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()


def location(root: str, content: str, options: Options) -> str:
    return f"{root.rstrip('/')}/{content[:12]}-{options.digest()[:10]}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of every document, in order of a batch's first use, with their counts."""
    for batch in batches:
        doc, dl, tokens = batch.columns
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
        coded = tokens.flatten().dictionary_encode()
        width = max(len(coded.dictionary), 1)
        place = np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy()
        place, tf = np.unique(place, return_counts=True)
        offsets = pa.array(np.searchsorted(place, np.arange(len(sizes) + 1) * width).astype(np.int32))
        terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(place % width)))
        tfs = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([doc, dl, terms, tfs], names=["doc_id", "dl", "terms", "tfs"])


def _range_blocks(number: int, rows: pa.Table, share: Callable) -> pa.RecordBatch:
    """The blocks of one range: of every term its documents by id, and the largest share of the idf."""
    rows = rows.combine_chunks()
    doc, dl, terms, tfs = (rows.column(c).combine_chunks() for c in ("doc_id", "dl", "terms", "tfs"))
    row = np.repeat(np.arange(len(doc)), pc.list_value_length(terms).to_numpy())
    coded, tf = terms.flatten().dictionary_encode(), tfs.flatten().to_numpy()
    at = np.empty(len(doc), dtype=np.int64)
    at[pc.sort_indices(doc, null_placement="at_start").to_numpy()] = np.arange(len(doc))
    code = coded.indices.to_numpy()
    order = np.lexsort((tf, at[row], code))
    code, row, tf = code[order], row[order], tf[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    length = dl.take(pa.array(row))
    entries = pa.StructArray.from_arrays([doc.take(pa.array(row)), pa.array(tf), length], names=["doc_id", "tf", "dl"])
    top = np.maximum.reduceat(share(tf, length.to_numpy()), first)
    ends = np.append(first, len(code))
    return pa.RecordBatch.from_arrays(
        [
            coded.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), number)), pa.array(top), pa.array(np.diff(ends)),
            pa.array(np.add.reduceat(tf, first)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries),
        ],
        names=["term", "range", "top", "df", "cf", "entries"],
    )


def _blocks(batches: Iterator[pa.RecordBatch], share: Callable) -> Iterator[pa.RecordBatch]:
    """Blocks of the ranges of a partition, which come one after another; no more than a range is held."""
    number, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and pc.sum(pc.list_value_length(rows.column("terms"))).as_py():
            yield _range_blocks(number, rows, share)

    for batch in batches:
        ranges = batch.column(batch.schema.get_field_index("range")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo and ranges[lo] != number:
                yield from done()
                number, held = int(ranges[lo]), []
            held.append(batch.slice(lo, hi - lo))
    yield from done()


def build(
    docs: DataFrame, root: str, options: Options = Options(), key: str = "doc_id", text: str = "text", content: str | None = None
) -> str:
    """Write the index unless it is there already; returns its folder."""
    spark = docs.sparkSession
    content = content or corpus_digest(docs, key, text)
    folder = location(root, content, options)
    if _exists(spark, f"{folder}/manifest"):
        return folder

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    tokens = lexical.analysed(docs, key, text).select(F.col(key).alias("doc_id"), "dl", "tokens")
    kind = dict(tokens.dtypes)["doc_id"]
    counted = tokens.mapInArrow(_counted, f"doc_id {kind}, dl int, {COUNTS}")
    # documents of similar length, and of each length class as many ranges as it needs
    length = F.coalesce("dl", F.lit(0))  # a null text counts as a document, but has no length
    counted = counted.withColumn("class", F.floor(4 * F.log2(length + 1)).cast("long"))
    rows = kept(counted, "counted")
    sizes = rows.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / RANGE_DOCS).alias("ranges"))  # one row a class, some 130 at most
    number = F.col("class") * (1 << 40) + F.pmod(F.xxhash64("doc_id"), F.col("ranges"))
    ranged = rows.join(F.broadcast(sizes), "class").select("doc_id", "dl", number.alias("range"), "terms", "tfs")
    documents = kept(ranged.select("doc_id", "dl", "range"), "documents")
    n, avg_dl, total = rows.agg(F.count(F.lit(1)), F.avg("dl"), F.sum(F.size("terms"))).first()
    # whole documents are dealt to their ranges, so no posting is shuffled
    dealt = ranged.repartition(1 + (total or 0) // PART_POSTINGS, "range").sortWithinPartitions("range")
    share = lambda tf, dl: lexical.weight(tf, dl, 1.0, avg_dl, options.k1, options.b)
    entry = f"array<struct<doc_id:{kind},tf:long,dl:int>>"
    grouped = dealt.mapInArrow(lambda b: _blocks(b, share), f"term string, range long, top double, df long, cf long, entries {entry}")
    blocks = kept(grouped.sortWithinPartitions("term", "range"), "blocks")
    terms = blocks.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    kept(terms.withColumn("idf", lexical.idf(F.col("df"), F.lit(n))).sortWithinPartitions("term"), "terms")
    sums = {t: _checksum(spark.read.parquet(f"{folder}/{t}")) for t in TABLES}
    manifest = {"version": VERSION, "content": content, "options": options.digest(), "n": n, "avg_dl": avg_dl, "tables": sums}
    spark.createDataFrame([{"manifest": json.dumps(manifest, sort_keys=True)}]).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/counted")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return folder


class IndexUnavailable(ValueError):
    """The folder holds no usable index."""


class LexicalIndex(lexical.Corpus):
    """Reads an index and answers query batches; ``verify`` compares the content of every table with the manifest."""

    def __init__(self, spark: SparkSession, folder: str, options: Options = Options(), verify: bool = True) -> None:
        if not _exists(spark, f"{folder}/manifest"):
            raise IndexUnavailable(f"no finished index in {folder}")
        manifest = json.loads(spark.read.json(f"{folder}/manifest").first()["manifest"])
        if manifest["version"] != VERSION:
            raise IndexUnavailable(f"index version {manifest['version']}, expected {VERSION}")
        if manifest["options"] != options.digest():
            raise IndexUnavailable("index was built with other options")
        self.documents, self.terms, self.blocks = (spark.read.parquet(f"{folder}/{t}") for t in TABLES)
        for name, frame in zip(TABLES, (self.documents, self.terms, self.blocks), strict=True) if verify else ():
            rows, digest = manifest["tables"][name]
            found = _checksum(frame)
            if found[0] != rows:
                raise IndexUnavailable(f"{name}: {found[0]} rows, manifest says {rows}")
            if found[1] != digest:
                raise IndexUnavailable(f"{name}: content differs from the manifest")
        self.options, self.manifest = options, manifest

    def lengths(self) -> DataFrame:
        return self.documents.select("doc_id", "dl")

    def size(self) -> Column:
        return F.lit(self.manifest["n"])

    def mean_length(self) -> Column:
        return F.lit(self.manifest["avg_dl"])

    def postings(self, vocabulary: DataFrame | None = None) -> DataFrame:
        rows = self.blocks.select("term", "entries")
        if vocabulary is not None:
            rows = rows.join(vocabulary.select("term").distinct(), "term", "left_semi")
        return rows.select("term", F.explode("entries").alias("e")).select("e.doc_id", "e.dl", "term", "e.tf")

    def frequencies(self, vocabulary: DataFrame | None = None) -> DataFrame:
        rows = self.terms.select("term", "df", "cf")
        return rows if vocabulary is None else rows.join(vocabulary.select("term").distinct(), "term", "left_semi")

    def bounds(self, asked: DataFrame) -> DataFrame:
        """(qid, range, bound): no document of the range scores more; ``asked`` is (qid, term, idf)."""
        parts = self.blocks.select("term", "range", "top").join(asked, "term")
        return parts.groupBy("qid", "range").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))

    def _scored(self, asked: DataFrame, ranges: DataFrame, only: DataFrame | None) -> DataFrame:
        wanted = asked.join(ranges.select("qid", "range"), "qid")
        rows = self.blocks.select("term", "range", "entries").join(wanted, ["term", "range"]).select("qid", "idf", F.explode("entries").alias("e"))
        if only is not None:
            rows = rows.join(only.select(F.col("doc_id").alias("o_doc")).distinct(), F.col("e.doc_id") == F.col("o_doc"), "left_semi")
        w = lexical.weight(F.col("e.tf"), F.col("e.dl"), F.col("idf"), self.mean_length(), self.options.k1, self.options.b)
        scores = rows.select("qid", F.col("e.doc_id").alias("doc_id"), w.alias("w")).groupBy("qid", "doc_id")
        return scores.agg(F.round(F.sum("w"), 6).alias("score")).where("score > 0")

    def search(self, queries: DataFrame, k: int = RETRIEVAL.top_k, only: DataFrame | None = None) -> DataFrame:
        """(qid, doc_id, score, rank); ``only`` restricts the documents before ranking and changes no weight."""
        asked = lexical.query_terms(queries).join(self.terms.select("term", "idf"), "term")
        best = (F.col("score").desc(), F.col("doc_id").asc())
        order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "range")
        ranges = self.bounds(asked).withColumn("turn", F.row_number().over(order))
        first = ranges.where(F.col("turn") <= SEED_RANGES)
        seeds = top_k(self._scored(asked, first, only), ["qid"], *best, k=k)
        least = seeds.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
        rest = ranges.where(F.col("turn") > SEED_RANGES).join(least, "qid", "left")
        open_ = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - ROUNDING))
        others = self._scored(asked, open_, only)
        return top_k(seeds.drop("rank").unionByName(others), ["qid"], *best, k=k)


_opened: dict[tuple[str, str], LexicalIndex] = {}


def of_table(spark: SparkSession, folder: str, options: Options = Options()) -> LexicalIndex:
    """The index of a table of documents, built when its files have none yet; kept in the shared folder of the session."""
    content = files_digest(spark, folder)
    known = spark.sparkContext.applicationId, location("", content, options)
    if known not in _opened:
        root = f"{shared_folder(spark)}/lexical"
        built = _exists(spark, f"{location(root, content, options)}/manifest")
        place = build(spark.read.parquet(folder), root, options, content=content)
        # what this session has just written needs no second look
        _opened[known] = LexicalIndex(spark, place, options, verify=built)
    return _opened[known]
