"""Reading a folder of documents: listing, hashing, decoding, front matter, quarantine, fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymark.functions.text import let

# What is read, and which front-matter names are kept.
EXTENSIONS = ("md", "txt", "pdf")
METADATA = "title id version effective_date valid_until published_date status supersedes doc_type applicant_type".split()
# The Windows Latin page differs from ISO 8859-1 in these code points.
_CODES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
WINDOWS = ("".join(map(chr, _CODES)), bytes(_CODES).decode("cp1252"))
LONGEST_VALUE = 120
FRONT_MATTER = r"\A---[ \t]*\n(?s:(.*?))\n---[ \t]*(?:\n|\z)"


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, name, format, sha256, bytes, content) of the visible files with a known extension; content is read lazily."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(~F.col("path").rlike(r"/\.[^/]+")).where(kind.isin(*extensions)).select(
        "path", name.alias("name"), kind.alias("format"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content"
    )


def decoded(content: Column) -> Column:
    """UTF-8 without its byte-order mark, else the Windows Latin page."""
    text = content.cast("string")
    latin = F.translate(F.decode(content, "iso-8859-1"), *WINDOWS)
    return F.regexp_replace(F.when(F.is_valid_utf8(text), text).otherwise(latin), "^﻿", "")


def metadata(block: Column, longest: int = LONGEST_VALUE) -> Column:
    """Whitelisted `name: value` lines: dates cut to the day, lists joined by commas, control characters removed.

    A value is cut at ``longest`` characters, and the names of cut values are listed under ``_cut``."""
    lines = F.filter(F.split(block, "\n"), lambda l: l.rlike(r"^[A-Za-z_]+:\s*\S"))
    pairs = F.transform(
        lines,
        lambda l: F.struct(
            F.lower(F.regexp_extract(l, r"^([A-Za-z_]+):", 1)).alias("k"),
            F.regexp_replace(F.trim(F.regexp_extract(l, r"^[A-Za-z_]+:\s*(.*)$", 1)), r"""^["']|["']$""", "").alias("v"),
        ),
    )

    def clean(v: Column) -> Column:
        v = F.when(v.rlike(r"^\[.*\]$"), F.regexp_replace(F.regexp_replace(v, r"^\[|\]$", ""), r"\s*,\s*", ",")).otherwise(v)
        v = F.regexp_replace(v, r"\p{Cntrl}", " ")
        day = F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)
        return F.when(day != "", day).otherwise(v)

    kept = F.filter(pairs, lambda p: p["k"].isin(METADATA))
    whole = F.transform(kept, lambda p: F.struct(p["k"].alias("k"), clean(p["v"]).alias("v")))

    def shortened(ps: Column) -> Column:
        long = F.filter(ps, lambda p: F.length(p["v"]) > longest)
        names = F.struct(F.lit("_cut").alias("k"), F.array_join(F.transform(long, lambda p: p["k"]), ",").alias("v"))
        short = F.transform(ps, lambda p: F.struct(p["k"].alias("k"), F.left(p["v"], F.lit(longest)).alias("v")))
        return F.map_from_entries(F.when(F.size(long) > 0, F.concat(short, F.array(names))).otherwise(short))

    return let(whole, shortened)


def load(files: DataFrame) -> DataFrame:
    """(path, name, format, sha256, status, reason, text, metadata): a bad file keeps its row and says why."""
    raw = decoded(F.col("content"))
    block = F.regexp_extract(raw, FRONT_MATTER, 1)
    rows = files.withColumn("raw", F.when(F.col("format") != "pdf", raw)).withColumn(
        "block", F.when(F.col("format") == "md", block).otherwise("")
    )
    reason = (
        F.when(F.col("format") == "pdf", "no reader for this format")
        .when(F.trim(F.regexp_replace("raw", r"\s+", "")) == "", "empty")
    )
    # the block gives way to as many blank lines, so that line numbers stay true
    blank = F.repeat(F.lit("\n"), F.regexp_count("block", F.lit("\n")) + 3)
    body = F.when(F.col("block") != "", F.concat(blank, F.regexp_replace("raw", FRONT_MATTER, ""))).otherwise(F.col("raw"))
    return rows.select(
        "path",
        "name",
        "format",
        "sha256",
        F.when(reason.isNull(), "loaded").otherwise("skipped").alias("status"),
        reason.alias("reason"),
        F.when(reason.isNull(), body).alias("text"),
        metadata(F.col("block")).alias("metadata"),
    )


def fingerprint(files: DataFrame, root: str, fixture: bool = False) -> DataFrame:
    """(corpus_hash, n_files): one digest of all (relative path, content digest) pairs.

    Parts of each pair's own digest are summed, so the result does not depend on the listing order and needs no sort.
    """
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    pair = F.sha2(F.concat_ws("\t", relative, "sha256"), 256)
    part = lambda a: F.sum(F.conv(F.substring(pair, a, 12), 16, 10).cast("decimal(38,0)"))
    sums = files.agg(F.count(F.lit(1)).alias("n_files"), *[part(a).alias(f"p{a}") for a in (1, 13, 25, 37)])
    listed = F.concat_ws("|", F.lit(f"fixture={fixture}"), *[F.col(f"p{a}").cast("string") for a in (1, 13, 25, 37)])
    return sums.select(F.sha2(listed, 256).alias("corpus_hash"), "n_files")


def status(spark: SparkSession, folder: str, fixture: bool = False) -> str:
    """AVAILABLE, TEST_FIXTURE or NOT_AVAILABLE."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return "NOT_AVAILABLE"
    if scan(spark, folder).limit(1).count() == 0:
        return "NOT_AVAILABLE"
    return "TEST_FIXTURE" if fixture else "AVAILABLE"


def document_ids(docs: DataFrame) -> DataFrame:
    """Native id from the front matter, else the file stem; a repeated native id is an error, a repeated stem gets a suffix."""
    native = F.try_element_at("metadata", F.lit("id"))
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    from quarrymark.operators.ordered import Split

    base = F.coalesce(native, stem)
    rows = docs.withColumn("native", native.isNotNull()).withColumn("base", base)
    placed = Split(["base"], ["path"], F.lit(0)).position(rows, "k")
    clash = F.col("native") & (F.col("k") > 1)
    chosen = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("k").cast("string")))
    checked = F.when(clash, F.raise_error(F.concat(F.lit("document id used twice: "), "base"))).otherwise(chosen)
    return placed.withColumn("document_id", checked.cast("string")).drop("native", "base", "k")
