from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

from labelwright.llm import warc
from labelwright.llm.warc import read_archives, write_archives

BIG, OTHER = "é" * 700, "x" * 1000
PAGES = [
    (1, "http://a/ b\n", BIG), (9, "http://b", BIG), (5, None, BIG), (2, "u", OTHER), (2, "u", OTHER), (3, "u", OTHER), (3, "u", OTHER),
    (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", OTHER), (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "v", "HTTP\r\n\r\nWARC/1.1\r\n" * 500), (None, None, "z" * 5000),
]


def expected():
    out = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        best = max(ids, default=None)
        refers = best if len(data) >= 1000 and best is not None and (page_id is None or page_id < best) else None
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def read(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, digest string")
    index = write_archives(pages, str(tmp_path / "w"))
    return index, read_archives(index, str(tmp_path / "w"), with_payload=True)


def test_round_trip(spark, tmp_path):
    index, records = read(spark, tmp_path)
    rows = records.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == expected()
    payloads = {(p, hashlib.sha1((h or "").encode()).hexdigest()): (h or "").encode() for p, _, h in PAGES}
    assert all(bytes(r.payload) == (payloads[r.page_id, r.payload_digest] if r.record_type == "response" else b"") for r in rows)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").iterdir())
    assert text.count(b"WARC-Type: ") == len(PAGES) and b"http://a/%20b%0A" in text
    assert {r.archive for r in index.collect()} == {p.name for p in Path(tmp_path / "w").iterdir()}


def test_small_archives_and_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    monkeypatch.setattr(warc, "READ", 500)
    index, records = read(spark, tmp_path)
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()]
    assert sorted(rows, key=str) == expected()
    some = read_archives(index.filter("page_id in (4, 12)"), str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in some) == [4, 12]


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert read_archives(write_archives(pages, str(tmp_path / "none")), str(tmp_path / "none")).count() == 0
