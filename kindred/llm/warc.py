"""WARC archives: a writer with revisit records, and a splittable reader.

Archives are ordinary .warc.gz files, one gzip member per record. A reading task gets a byte range,
scans it for the gzip magic, accepts a candidate only if what it decodes to starts with a WARC
header, and owns the records whose first byte lies in its range, reading past the end of the range
for the last of them. Files are opened through pyarrow's file systems, so the archives may lie in
any store that those reach (local or shared folders, HDFS, S3).
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, small_batches

#: Payloads below so many bytes are never written as revisits.
LEAST_REVISIT = 100
SPLIT_BYTES = 32 << 20
MAGIC = b"\x1f\x8b\x08"
RECORD_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _id(value: int | None) -> str:
    return f"<urn:page:{'' if value is None else value}>"


def _number(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def encode_record(page_id: int | None, url: str | None, payload: bytes | int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as one gzip member. A revisit holds the HTTP headers only, so its payload's size will do."""
    size = payload if isinstance(payload, int) else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[tuple[str, int]]:
    """Writes a record per row into one archive per task; returns the files and their sizes.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, that with the smallest id is the
    response and the others revisit it. Null html is an empty payload; rows that repeat the smallest
    id are responses each; a null id counts as the largest. Only the named columns are read, so others may have
    any names. A file appears under its name only when whole, and a task that runs again writes it anew.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids, urls, digests = (part.column(k).to_pylist() for k in (0, 1, 3))
                payloads = part.column(2)
                records = [encode_record(ids[i], urls[i], payloads[i].as_py(), digests[i], None, False) for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pc.binary_length(payloads).cast(pa.int64()), part.column(3), pa.array(records, pa.binary())], ["page_id", "url", "size", "digest", "record"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(path)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}.warc.gz"
        part = f"{name}.{context.taskAttemptId()}.part"
        total = 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                digest, page_id, url, size, record, first = (batch.column(batch.schema.get_field_index(c)) for c in ("digest", "page_id", "url", "size", "record", "first"))
                for i in range(batch.num_rows):
                    own, other = page_id[i].as_py(), first[i].as_py()
                    if other is not None and own != other:
                        total += out.write(encode_record(own, url[i].as_py(), size[i].as_py(), digest[i].as_py(), other, True))
                    else:
                        total += out.write(record[i].as_buffer())
        store.move(part, name)
        yield pa.RecordBatch.from_pydict({"name": [name.rpartition("/")[2]], "size": pa.array([total], pa.int64())})

    # payloads are compressed where they are read; the shuffle that brings revisits to their responses moves records
    records = rows.mapInArrow(encode, "page_id long, url string, size long, digest string, record binary").join(firsts, "digest", "left")
    with small_batches(pages.sparkSession):
        done = records.mapInArrow(write, "name string, size long").collect()
    return [(f"{path.rstrip('/')}/{r['name']}", r["size"]) for r in done]


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}


class _Window:
    """A file read forward through a buffer."""

    def __init__(self, file, size: int, start: int, end: int):
        self.file, self.size, self.at = file, size, start
        self.data = file.read_at(max(0, min(end, size) - start), start)

    def more(self) -> bytes:
        """The bytes after the buffer, appended to it; empty at the end of the file."""
        at = self.at + len(self.data)
        got = self.file.read_at(min(1 << 20, self.size - at), at) if at < self.size else b""
        self.data += got
        return got


def scan_range(file, size: int, start: int, end: int, on_error: str = "raise") -> Iterator[dict]:
    """The records whose first byte lies in [start, end) of an archive of `size` bytes."""
    window, i = _Window(file, size, start, end), 0
    while True:
        i = window.data.find(MAGIC, i)
        if i < 0:
            # a magic number may straddle the end of the range
            if start + len(window.data) - end < len(MAGIC) - 1 and window.more():
                i = max(0, end - start - len(MAGIC) + 1)
                continue
            return
        if start + i >= end:
            return
        inflate, pieces, at, bad = zlib.decompressobj(31), [], i, False
        try:
            while not inflate.eof:
                if at >= len(window.data) and not window.more():
                    bad = True
                    break
                piece = window.data[at : at + (1 << 16)]
                pieces.append(inflate.decompress(piece))
                at += len(piece)
                if len(pieces) == 1 and len(pieces[0]) >= 7 and not pieces[0].startswith(b"WARC/1."):
                    break
        except zlib.error:
            bad = True
        text = b"".join(pieces)
        if not text.startswith(b"WARC/1."):
            i += 1  # the magic number by chance, within a member
            continue
        if bad:
            if on_error == "raise":
                raise ValueError(f"broken record at byte {start + i}")
            i += 1
            continue
        i = at - len(inflate.unused_data)
        head, _, rest = text.partition(b"\r\n\r\n")
        named = _headers(head)
        block = rest[: int(named.get("content-length", 0))]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield {"named": named, "http": _headers(http), "payload": payload}


def read_warc(spark: SparkSession, files: list[tuple[str, int]], *, split_bytes: int = SPLIT_BYTES, payload: bool = True, on_error: str = "raise") -> DataFrame:
    """The records of archives, a task per byte range: id, url, payload, its size and SHA-256, kind, and whom it refers to.

    A response's size and digest are taken from its payload, and the digest must agree with its header; a revisit
    has none and states those of the record it refers to. payload=False leaves the column null. No archives: no rows.
    A payload of arbitrary bytes that holds a whole archive member may be taken for a record if a range starts inside it; UTF-8
    text can't hold the magic number.
    """
    ranges = sum(-(-size // split_bytes) for _, size in files)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    parts = spark.createDataFrame(files, "path string, size long").filter("size > 0").select("path", "size", starts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        out: dict[str, list] = {k: [] for k in kinds}
        held = 0
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = _open(path)
                with store.open_input_file(name) as file:
                    for r in scan_range(file, size, start, min(size, start + split_bytes), on_error):
                        named, revisit = r["named"], r["named"].get("warc-type") == "revisit"
                        said = named.get("warc-payload-digest", "").removeprefix("sha256:")
                        digest = said if revisit else hashlib.sha256(r["payload"]).hexdigest()
                        if digest != said and on_error == "raise":
                            raise ValueError(f"digest of {named.get('warc-record-id')} in {path} differs")
                        url = named.get("warc-target-uri")
                        out["page_id"].append(_number(named.get("warc-record-id")))
                        out["url"].append(None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 0x80 else m[0], url))
                        out["payload"].append(r["payload"] if payload and not revisit else None)
                        out["payload_bytes"].append(int(r["http"].get("content-length", 0)) if revisit else len(r["payload"]))
                        out["payload_digest"].append(digest)
                        out["record_type"].append("revisit" if revisit else "response")
                        out["refers_to"].append(_number(named.get("warc-refers-to")) if revisit else None)
                        held += len(r["payload"]) if payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})
                            out, held = {k: [] for k in kinds}, 0
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return parts.repartition(max(1, ranges)).mapInArrow(scan, RECORD_SCHEMA)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives: written with revisits, read back in byte ranges."""
    path = scratch(spark, "warc")
    files = write_warc(read(spark, sf_dir, "pages"), path)
    return read_warc(spark, files, split_bytes=8 << 20, payload=False).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM q)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM r
"""
