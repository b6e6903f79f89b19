"""WARC archives: write record-compressed files, index first, read by ranges.

``write_archive`` writes one gzip member per record (WARC/1.1 ``response`` or
``revisit``) into ``.warc.gz`` files of a shared folder, and returns the index:
one row per record with file, offset, length, URL and payload digest.  The
index is stored as a table before anything is read.  ``read_records`` takes any
selection of index rows, range-partitions them by (file, offset) and merges
neighbouring byte ranges, so that each task makes a few large sequential reads.

Executors may be lost: a file name carries a random part per task attempt, and
only the rows of the attempt that Spark commits reach the index, so files of
lost attempts are never read.  Files are opened through ``pyarrow.fs``, which
resolves local, HDFS and object-store URIs.

De-duplication (``record_roles``): of records with equal payloads of at least
``min_bytes`` the one with the smallest id is the response, others revisit it.
Copies are counted by a partial aggregation on the digest, and the join back
has narrow rows only, which the adaptive skew join may split.

Defined results: null html is an empty payload; a null URL writes no target
header and reads back null; control characters in URLs are percent-encoded in
the header only; rows that repeat the smallest id of a payload are all
responses; rows with null id refer to the smallest non-null id, and are
responses where there is none; an empty table gives an empty index.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names and forms of the WARC/1.1 format.
VERSION, CRLF = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

INDEX_SCHEMA = ("file string, offset long, length long, url string, digest string, "
                "record_id string, record_type string, refers_to string")
RECORD_SCHEMA = ("record_id string, url string, record_type string, refers_to string, digest string, "
                 "payload_bytes long, payload binary")


def record_roles(records: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Adds ``record_type`` and ``refers_to`` to rows of (record_id, digest, payload_bytes, ...)."""
    first = records.where(F.col("payload_bytes") >= min_bytes).groupBy("digest") \
        .agg(F.min("record_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    j = records.join(first, "digest", "left")
    revisit = F.coalesce((F.col("payload_bytes") >= min_bytes) & F.col("_first").isNotNull()
                         & ~F.col("record_id").eqNullSafe(F.col("_first")), F.lit(False))
    return j.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")) \
        .withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_first")


def _header_value(v: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", v)


def encode_record(record_id, url, html, digest: str, payload_bytes: int, record_type: str, refers_to, date: str) -> bytes:
    """One WARC record as its own gzip member."""
    name = "null" if record_id is None else str(record_id)
    head = [f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:quarry:record:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {payload_bytes}"]
    if record_type == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:quarry:record:{refers_to}>"]
        block = b""
    else:
        body = (html or "").encode("utf-8", "surrogatepass")
        block = HTTP_HEAD % len(body) + body
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = VERSION + CRLF + "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF
    return gzip.compress(raw, compresslevel=6, mtime=0)


def decode_record(member: bytes) -> tuple[dict, bytes]:
    """Headers and payload of a gzip member; checks the version and the block length."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:20]!r}")
    fields = dict(x.decode().split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != CRLF + CRLF:
        raise ValueError("WARC record with a wrong length")
    return fields, block.partition(CRLF + CRLF)[2]


def _open_fs(uri: str):
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^s3a://", "s3://", re.sub(r"^file:/+", "file:///", uri)))


def write_archive(records: DataFrame, folder: str, max_file_bytes: int = 256 << 20,
                  date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write rows of (record_id, url, html, digest, payload_bytes, record_type, refers_to); returns
    the lazy index.  Store it before reading: computing it is what writes the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, name, offset = None, None, 0
        try:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    if out is None or offset >= max_file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                    rid, ref = r.record_id, r.refers_to
                    member = encode_record(rid, r.url, r.html, r.digest, int(r.payload_bytes), r.record_type, ref, date)
                    out.write(member)
                    rows.append((name, offset, len(member), r.url, r.digest, rid, r.record_type, ref))
                    offset += len(member)
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "url", "digest", "record_id", "record_type",
                                                  "refers_to"])
        finally:
            if out is not None:
                out.close()

    ids = [F.col(c).cast("string").alias(c) for c in ("record_id", "refers_to")]  # exact in pandas, also beside nulls
    return records.select(*ids, "url", "html", "digest", "payload_bytes", "record_type").mapInPandas(run, INDEX_SCHEMA) \
        .withColumns({c: F.col(c).cast("long") for c in ("record_id", "refers_to")})


def coalesce_ranges(offsets, lengths, gap: int, span: int) -> list[tuple[int, int, int, int]]:
    """Sorted ranges merged into reads: (start, end, first row, row after the last); a read
    bridges holes of up to ``gap`` bytes and stops growing at ``span`` bytes."""
    reads: list[list[int]] = []
    for i, (o, n) in enumerate(zip(offsets, lengths)):
        if reads and o - reads[-1][1] <= gap and o + n - reads[-1][0] <= span:
            reads[-1][1], reads[-1][3] = max(reads[-1][1], o + n), i + 1
        else:
            reads.append([o, o + n, i, i + 1])
    return [tuple(r) for r in reads]


def read_records(index: DataFrame, folder: str, partitions: int, with_payload: bool = True,
                 gap: int = 64 << 10, span: int = 8 << 20) -> DataFrame:
    """Read the selected index rows back: ``RECORD_SCHEMA``.  A revisit has no payload of its own; its
    digest and size are those its header names.  Payload digests are verified."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open_fs(folder)
        name, src = None, None
        for pdf in batches:
            for file, part in pdf.groupby("file", sort=False):
                if file != name:
                    if src is not None:
                        src.close()
                    name, src = file, fs.open_input_file(f"{root.rstrip('/')}/{file}")
                off, length, urls = part["offset"].tolist(), part["length"].tolist(), part["url"].tolist()
                for start, end, a, b in coalesce_ranges(off, length, gap, span):
                    buf = src.read_at(end - start, start)
                    rows = []
                    for i in range(a, b):
                        h, payload = decode_record(buf[off[i] - start: off[i] - start + length[i]])
                        kind = h["WARC-Type"]
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(h["X-Payload-Bytes"])
                        if kind == "response":
                            size = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{file} at {off[i]}: payload digest differs")
                        rid = h["WARC-Record-ID"].rpartition(":")[2].rstrip(">")
                        ref = h.get("WARC-Refers-To", "").rpartition(":")[2].rstrip(">")
                        rows.append((None if rid == "null" else rid, urls[i], kind, ref or None, digest,
                                     size, payload if with_payload and kind == "response" else None))
                    yield pd.DataFrame(rows, columns=["record_id", "url", "record_type", "refers_to", "digest",
                                                      "payload_bytes", "payload"])
        if src is not None:
            src.close()

    return index.select("file", "offset", "length", "url").repartitionByRange(partitions, "file", "offset") \
        .sortWithinPartitions("file", "offset").mapInPandas(run, RECORD_SCHEMA) \
        .withColumns({c: F.col(c).cast("long") for c in ("record_id", "refers_to")})
