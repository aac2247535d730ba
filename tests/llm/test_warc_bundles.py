from __future__ import annotations

import hashlib
import struct
from collections import Counter

import zstandard
from corpus_cases import from_folder
from pyspark.sql import functions as F

from quarrymark.llm import store
from quarrymark.llm import warc_bundles as warc
from quarrymark.llm.shared_files import place

SCHEMA = "page_id long, url string, html string, digest string, refers_to string, bundle string"


def expected(rows) -> Counter:
    groups: dict[str, list] = {}
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in rows]
    for page, payload in pages:
        if len(payload) >= 1000:
            groups.setdefault(hashlib.sha1(payload).hexdigest(), []).append(page)
    out = Counter()
    for page, payload in pages:
        digest = hashlib.sha1(payload).hexdigest()
        known = [p for p in groups.get(digest, []) if p is not None]
        revisit = bool(known) and page != max(known)
        out[page, len(payload), digest, "revisit" if revisit else "response", max(known) if revisit else None, True] += 1
    return out


def cases(spark):
    long, longer = "<p>ü text</p>" * 100, "<p>other</p>" * 200
    rows = [
        (1, "http://a/1", long),
        (2, "http://a/2", long),
        (3, None, long),
        (3, None, long),
        (4, "http://a/4", "short"),
        (5, "http://a/5", "short"),
        (6, "http://a/6", None),
        (7, "", ""),
        (None, "http://a/8", long),
        (None, None, longer),
        (None, None, longer),
        (9, "http://a\r\nX: 1", "\r\n\r\nWARC/1.1\r\n" * 90),
        (10, "http://a/ü ?q=1", "x" * 3_000_000),
    ]
    return spark.createDataFrame([(*r, "d", "r", "b") for r in rows], SCHEMA)


def test_pages(spark):
    pages = from_folder(spark, "pages")
    assert Counter(tuple(r) for r in warc.digests(pages).collect()) == expected(pages.collect())


def test_awkward(spark):
    pages = cases(spark)
    assert Counter(tuple(r) for r in warc.digests(pages).collect()) == expected(pages.collect())
    assert warc.digests(pages.where("false")).count() == 0


def test_payloads_come_back_and_one_record_can_be_sought(spark):
    pages = from_folder(spark, "pages")
    target = store.folder(spark, "warc-test")
    index = warc.write(warc.roles(pages), target)
    html = {r["page_id"]: r["html"].encode() for r in pages.collect()}
    back = warc.read(index).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in back} == html
    one = warc.read(warc.read_index(spark, target).where(F.col("page_id") == 17)).collect()
    assert [bytes(r["payload"]) for r in one] == [html[17]] and one[0]["url"] == back[[r["page_id"] for r in back].index(17)]["url"]


def test_frames_are_independent_and_the_footer_describes_them(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 20_000)
    uri = store.folder(spark, "bundle") + ".warc.zst"
    bundle = warc.Bundle(uri)
    records = [warc.record(i, f"http://a/{i}", bytes([65 + i]) * 7000, hashlib.sha1(bytes([65 + i]) * 7000).hexdigest(), None)[1] for i in range(9)]
    places = [bundle.add(r) for r in records]
    bundle.close()
    system, path = place(uri)
    with system.open_input_file(path) as f:
        table = warc.seek_table(f, f.size())
        f.seek(0)
        whole = f.read()
    assert len(table) == 3 and struct.unpack("<I", whole[-4:])[0] == 0x8F92EAB1
    for (frame, offset), data in zip(places, records, strict=True):
        start, packed, plain = table[frame]
        text = zstandard.ZstdDecompressor().decompress(whole[start : start + packed])
        assert len(text) == plain and text[offset : offset + len(data)] == data
    # any Zstandard reader sees one stream; the seek table is a skippable frame
    reader = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True)
    assert reader.read() == b"".join(records)
