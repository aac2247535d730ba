"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole records, closed by a seek table in a skippable frame:
for every frame its compressed and its decompressed size, then frame count, a flag byte and the magic number of the seekable format.
A reader fetches the footer, adds up the sizes and decompresses just the frame it needs.  The index, a Parquet table beside the
bundles, maps each record id to (bundle, frame, offset and length inside the decompressed frame).

Payloads of at least ``LEAST_REVISIT`` bytes that several pages share are stored once: the record of the largest page id is the
response, all others are revisit records that keep the HTTP header (with its length) and the payload digest.

Every task writes bundles of bounded size, one frame in memory at a time; a file name holds the attempt, and only bundles named
by the index (which is committed by Spark) are ever read, so retried tasks do no harm.  Groups of equal payloads meet only as
one count row per digest; the join that brings it back to the pages is split by Spark where a digest is hot.

Defined cases: null html is an empty payload, a null url an empty target; pages that share the largest id of a group are all
responses; a null page id loses against any other, and is a response if its group has no id at all; identical rows write identical
records with one record id; an empty table gives no bundle and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymark.llm.shared_files import place
from quarrymark.llm.store import folder, written

LEAST_REVISIT = 1000
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3

# Fixed values of the formats written here.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"

INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORDS = (
    "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, intact boolean"
)


def roles(pages: DataFrame) -> DataFrame:
    """Pages with payload digest, size and, for a revisit, the page id it refers to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = F.octet_length("html") >= LEAST_REVISIT
    shared = (
        rows.where(large)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND keeper IS NOT NULL")
        .select("digest", "keeper")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull()
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(other, F.col("keeper")).alias("refers_to")
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[str, bytes]:
    """Record id and the bytes of one WARC record."""
    name = record_id(page_id, digest)
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    target = "" if url is None else " ".join(url.split())
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", RECORD_DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", IDENTICAL_PAYLOAD),
            ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>"),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return name, head.encode() + block + b"\r\n\r\n"


class Bundle:
    """One bundle file being written, a frame at a time."""

    def __init__(self, uri: str) -> None:
        self.uri = uri
        system, path = place(uri)
        self.file = system.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.pending = bytearray()
        self.packed = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset of the record inside that frame."""
        at = len(self.frames), len(self.pending)
        self.pending += data
        if len(self.pending) >= FRAME_BYTES:
            self.flush()
        return at

    def flush(self) -> None:
        if self.pending:
            frame = self.packer.compress(bytes(self.pending))
            self.file.write(frame)
            self.frames.append((len(frame), len(self.pending)))
            self.packed += len(frame)
            self.pending = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.file.close()


def write(rows: DataFrame, target: str) -> DataFrame:
    """Write bundles under ``target`` and return the committed index."""
    spark = rows.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"{target}/bundle-{context.partitionId():06d}-{context.taskAttemptId()}"
        bundle: Bundle | None = None
        made = 0
        for batch in batches:
            index: list[tuple] = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    system, path = place(target)
                    system.create_dir(path, recursive=True)
                    bundle = Bundle(f"{stem}-{made:04d}.warc.zst")
                    made += 1
                name, data = record(page_id, url, html.encode(), digest, refers_to)
                frame, offset = bundle.add(data)
                index.append((name, page_id, bundle.uri, frame, offset, len(data)))
                if bundle.packed >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*index, strict=True)], schema=_INDEX)
        if bundle is not None:
            bundle.close()

    slim = rows.select("page_id", "url", "html", "digest", "refers_to")
    slim.mapInArrow(pack, INDEX).write.parquet(f"{target}/index")
    return read_index(spark, target)


_INDEX = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32())]
    + [("offset", pa.int64()), ("length", pa.int64())]
)
_RECORDS = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string())]
    + [("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("payload", pa.binary()), ("intact", pa.bool_())]
)


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of every frame, from the footer alone."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC or flags != 0:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - 9 - 8 * count)
    sizes = list(struct.iter_unpack("<II", file.read(8 * count)))
    out, start = [], 0
    for packed, plain in sizes:
        out.append((start, packed, plain))
        start += packed
    return out


def parse(data: bytes) -> tuple:
    """One record's bytes to a row of RECORDS; ``intact`` says that a stored payload has its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    intact = revisit or (len(payload) == length and hashlib.sha1(payload).hexdigest() == digest)
    number = lambda v: int(v) if v else None
    return (
        fields["WARC-Record-ID"].strip("<>"),
        number(fields["X-Page-ID"]),
        fields["WARC-Target-URI"],
        fields["WARC-Type"],
        number(fields.get("X-Refers-To-Page-ID")),
        length,
        digest,
        None if revisit else payload,
        intact,
    )


def read(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, in any number: each bundle is opened once, and only the frames asked for are unpacked.

    Passing some rows of the index is a seek by record id; passing all of it reads the archives back.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, file, table, frame, plain = None, None, [], -1, b""
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for uri, number, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != bundle:
                    system, path = place(uri)
                    file = system.open_input_file(path)
                    table, bundle, frame = seek_table(file, file.size()), uri, -1
                if number != frame:
                    start, packed, _ = table[number]
                    file.seek(start)
                    plain, frame = unzip.decompress(file.read(packed)), number
                rows.append(parse(plain[offset : offset + length]))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)

    asked = index.select("bundle", "frame", "offset", "length")
    # a stated number of partitions: the index is small, but what its rows make a task read is not
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_frame = asked.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return by_frame.mapInArrow(unpack, RECORDS)


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, one row a record."""
    target = folder(pages.sparkSession, "warc")
    index = write(roles(pages), target)
    return read(index)


def digests(pages: DataFrame) -> DataFrame:
    back = archived(pages)
    return back.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )
