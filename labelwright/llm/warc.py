"""WARC archives with an index that is written first and drives every later read.

Writing: each task appends records, a gzip member each, to archives of bounded size in
the shared folder and returns an index row per record: archive, offset, length, address and
payload digest.  Archives carry a name of their own per attempt, and only a finished
task's rows reach the index; so a repeated or speculative attempt leaves an archive that no row names.

Reading: the selected index rows are sorted by archive and offset, neighbouring byte ranges are
coalesced into reads of bounded size, and each record is cut out, unpacked, parsed
and held against the digest of its index row.

Defined cases: a null page has an empty payload; of repeated rows with the largest id of
their payload all are responses; a page without an id refers to the response if its payload
has one with an id, and is a response otherwise; a null address is written empty; control characters
and blanks in addresses are percent-encoded; pages of any length are written whole; an empty table gives no
archives and an empty index; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from base64 import b16encode, b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Archives are closed beyond this size.
ARCHIVE_BYTES = 256 << 20
#: A coalesced read spans gaps of up to GAP bytes and READ bytes in all, or one record.
GAP, READ = 64 << 10, 8 << 20
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id bigint, url string, archive string, offset bigint, length bigint, digest string, payload_bytes bigint, record_type string"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("s3://" + uri[6:] if uri.startswith("s3a://") else uri)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    address = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    kind = "response" if refers_to is None else "revisit"
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode(), b"", b""]
    block = b"\r\n".join(http) + (payload if refers_to is None else b"")
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head = "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass")
    return head + block + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    out, path, offset = None, "", 0
    store, root = open_store(folder)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string())])
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                if out is None or offset > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    else:
                        store.create_dir(root, recursive=True)
                    path, offset = posixpath.join(root, f"{uuid.uuid4().hex}.warc.gz"), 0
                    out = store.open_output_stream(path, compression=None)  # members are packed one by one
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(_record(page_id, url, payload, digest, refers_to)) + packer.flush()
                out.write(member)
                rows.append((page_id, url, posixpath.basename(path), offset, len(member), digest, len(payload), "response" if refers_to is None else "revisit"))
                offset += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into ``folder``; the index comes back, materialised.

    Of records with equal payloads of at least ``least_revisit`` bytes, the one with the
    largest id is a response and the others revisit it.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")}
    )
    lean = rows.select("page_id", "digest", "size").filter(F.col("size") >= least_revisit)
    groups = lean.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = lean.join(groups, ["digest", "size"]).filter("refers_to is not null and (page_id is null or page_id < refers_to)")
    revisits = later.select(F.col("page_id").alias("id"), F.col("digest").alias("same"), "refers_to").distinct()
    known = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("same")), "left")
    return cut(known.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(lambda b: _write(b, folder), INDEX))


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").rstrip(">")
    return int(digits) if digits else None


def _read_record(member: bytes, expected: str) -> tuple:
    fields, block = _parse(zlib.decompress(member, 31))
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = b16encode(b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))).decode().lower()
    if digest != expected or fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its index row")
    return _page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), payload


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    store, root = open_store(folder)
    source, opened, run = None, None, []

    def fetch():
        nonlocal source, opened
        if run[0][0] != opened:
            if source is not None:
                source.close()
            opened = run[0][0]
            source = store.open_input_file(posixpath.join(root, opened))
        start, end = run[0][1], run[-1][1] + run[-1][2]
        source.seek(start)
        data = source.read(end - start)
        found = [_read_record(data[o - start : o - start + n], digest) for _, o, n, digest in run]
        run.clear()
        columns = [*zip(*found, strict=True)]
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        if with_payload:
            arrays, names = [*arrays, pa.array(columns[5], pa.binary())], [*names, "payload"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run:
                archive, offset, length, _ = run[-1]
                if row[0] != archive or row[1] - offset - length > GAP or row[1] + row[2] - run[0][1] > READ:
                    yield fetch()
            run.append(row)
    if run:
        yield fetch()
    if source is not None:
        source.close()


def read_archives(selected: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that the index rows ``selected`` name; with ``payload`` (empty for revisits) if asked for."""
    ranges = selected.select("archive", "offset", "length", "digest").repartition("archive").sortWithinPartitions("archive", "offset")
    return ranges.mapInArrow(lambda b: _read(b, folder, with_payload), RECORDS + (", payload binary" if with_payload else ""))
