"""WARC archives with an index first: every record's file, offset, length, URL and
digest go to an index table, and selected records are read back by sorted, coalesced
byte ranges.

Records are gzip members one after the other, as is usual for WARC, so each can be
read alone. Of records with equal payloads (same SHA-1 and length) the one with the
smallest id holds the payload; the others are revisits that name it.

Archives are written by tasks, each to files of its own name per attempt; the index is
written by Spark's committer, and only files it names count. So a lost executor or a
second attempt leaves at most files that nobody reads. Memory per task: a batch of
pages when writing, one byte range when reading (or one record, if that is longer). A group of equal pages is counted by
a partial aggregate and joined back, with AQE splitting a hot one.

The archive folder must be open to the executors by pyarrow's file systems (file, s3,
gs, hdfs); by default it lies in the shared folder of spark.checkpoint.dir.

Defined cases: null html is an empty payload; a null url is written as urn:page:<id>;
blanks and control characters in a url are percent-encoded; repeated rows of the
smallest id are all responses; a null id refers to the group's smallest id, or is a
response if its group has none; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from giftrisk.llm.common import query, scratch_path, stage

ARCHIVE_BYTES = 64 << 20
#: Two ranges are read at once if this many bytes or fewer lie between them, up to
#: RANGE_BYTES together.
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20
#: Archive bytes that a task reads back.
TASK_BYTES = 128 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One WARC record; ``payload`` None: a revisit of ``refers_to``."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, dict, bytes]:
    """(WARC headers, HTTP headers, payload) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(warc["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record without its end")
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), payload


def gzip_member(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives of ``pages(page_id, url, html)`` to ``folder``; the index."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", payload.alias("html"),
                         F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    copies = (pages.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .where("n > 1 and first is not null").drop("n"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    todo = pages.join(copies, ["digest", "size"], "left").select(
        "page_id", "url", "digest", "size", F.when(revisit, F.col("first")).alias("refers_to"), F.when(~revisit, F.col("html")).alias("html"))

    def run(batches):
        fs, root = open_fs(folder)
        out, at = None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, digest, size, refers, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "refers_to")),
                                                                   batch.column("html").cast(pa.binary()).to_pylist()):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                    member = gzip_member(record(page_id, url, html, size, b32, refers))
                    out.write(member)
                    rows.append((page_id, url, b32, "revisit" if html is None else "response", name, at, len(member)))
                    at += len(member)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                cols = zip(*rows) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return stage(todo.mapInArrow(run, INDEX), "warc_index")


def ranges(rows: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Coalesce sorted (offset, length) to (first row, end row, offset, length)."""
    out: list = []
    for i, (at, size) in enumerate(rows):
        if out and at - (out[-1][2] + out[-1][3]) <= GAP_BYTES and at + size - out[-1][2] <= RANGE_BYTES:
            first, _, begin, length = out[-1]
            out[-1] = (first, i + 1, begin, max(length, at + size - begin))
        else:
            out.append((i, i + 1, at, size))
    return out


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(selected: DataFrame, folder: str) -> DataFrame:
    """The records of an index, or of any part of it, read by byte ranges: sorted by
    file and offset, neighbours in one request. A response's digest is computed anew
    and must be the recorded one; a revisit has no payload.

    Stretches of RANGE_BYTES of the files are dealt to so many tasks that each reads
    about TASK_BYTES, or to all cores if that is less: the archives' size decides, not
    the index's."""
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), min(selected.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES)))

    def run(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            files, at, size = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            rows = []
            first = 0
            while first < len(files):
                end = first
                while end < len(files) and files[end] == files[first]:
                    end += 1
                with fs.open_input_file(f"{root}/{files[first]}") as f:
                    for a, b, begin, length in ranges(list(zip(at[first:end], size[first:end]))):
                        f.seek(begin)
                        data = f.read(length)
                        for i in range(first + a, first + b):
                            rows.append(unpack(zlib.decompress(data[at[i] - begin:at[i] - begin + size[i]], 31)))
                            if len(rows) >= 256:
                                yield to_batch(rows)
                                rows = []
                first = end
            if rows:
                yield to_batch(rows)

    def unpack(raw):
        warc, http, payload = parse(raw)
        digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {warc['WARC-Record-ID']} is not what was recorded")
        number = lambda k: int(warc[k]) if k in warc else None
        return (number("X-Page-ID"), warc["WARC-Target-URI"], int(http["Content-Length"]) if kind == "revisit" else len(payload),
                digest, kind, number("X-Refers-To-Page"), payload if kind == "response" else None)

    def to_batch(rows):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in RECORDS.split(", ")])

    stretch = F.floor(F.col("offset") / RANGE_BYTES)
    return (selected.select("file", "offset", "length").repartition(tasks, "file", stretch)
            .sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, h FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST('0x' || hex[5 * i + 1:5 * i + 5] AS BIGINT) >> s) & 31 AS INTEGER) + 1]), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM r
"""


@query("op3_warc_index", SQL)
def op3(spark, sf_dir):
    folder = scratch_path(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
