"""WARC archives with revisit resolution.

``write_archives`` digests payloads, shuffles only headers by digest, takes the smallest page id of equal payloads of
``least`` bytes or more as the original, and writes gzip-per-record WARC/1.1 files in which all others are revisit
records with headers of their own and no payload. ``read_archives`` reads the files back and joins revisits to the
original responses.

Payloads meet their decision by page id, which is even, not by digest, of which a third of all pages may share one.
Files are listed in a manifest (see files), so repeated task attempts do no harm.

Defined results: a null payload is empty and always a response. Rows that repeat page id and payload are one capture and
get its type. A page without an id is never an original if its payload has another with an id; if none has, all are
responses. Control characters in a URL are percent-encoded, a null URL is about:blank.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import files
from quern.llm.common import BROADCAST_KEYS, Workspace
from quern.llm.words import blocks

#: Smallest payload that may be a revisit, and payload bytes after which a task begins a new file.
LEAST, FILE_BYTES = 100, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes that a reader feeds at once, and bytes of original URLs that may be broadcast.
FEED, URL_BYTES = 1 << 14, 16 << 20


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def record(page_id: int | None, url: str | None, digest: str, payload: bytes | None, date: str, original: int | None = None, original_url: str | None = None) -> bytes:
    """A response with its payload, or a revisit of an original without; date: when the archives are written."""
    revisit = payload is None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}", f"WARC-Refers-To-Target-URI: {_uri(original_url)}", f"WARC-Refers-To-Date: {date}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"\r\n" if revisit else f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record of a file with one gzip member per record."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(raw):
                raise ValueError("a WARC record ends early")
            parts.append(member.decompress(view[at : at + FEED]))
            at += min(FEED, len(raw) - at)
        at -= len(member.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        yield fields, block.partition(b"\r\n\r\n")[2]


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, original, original_url) of the pages that repeat an original; pages has digest and payload_bytes."""
    headers = pages.filter(F.col("payload_bytes") >= least).select("page_id", "url", "digest")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = headers.groupBy("digest").agg(F.min(named).alias("o"), F.count("*").alias("c")).filter("c > 1 and o is not null")
    found = headers.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("o.page_id")))
    return found.select("page_id", "digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url")).distinct()


def write_archives(pages: DataFrame, work: Workspace, payload: str = "html", least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, payload) as archives below work; the manifest: (name, n_records)."""
    text = F.coalesce(F.col(payload), F.lit(""))
    pages = pages.select("page_id", "url", text.alias("payload"), F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("payload_bytes"))
    again = work.save(revisits(pages, least), "revisits").withColumnRenamed("page_id", "r_page").withColumnRenamed("digest", "r_digest")
    n, url_bytes = again.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("original_url")), F.lit(0))).first()
    small = n <= BROADCAST_KEYS // 4 and url_bytes <= URL_BYTES
    rows = pages.join(F.broadcast(again) if small else again, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    rows = rows.select("page_id", "url", "digest", "original", "original_url", F.col("r_digest").isNotNull().alias("revisit"), F.when(F.col("r_digest").isNull(), F.col("payload")).alias("payload"))
    folder, date = f"{work.path}/archives", datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            row = {"name": [files.put(folder, ".warc.gz", b"".join(held))], "n_records": [len(held)]}
            held, size = [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in blocks(batches, "payload"):
            for page, url, digest, original, original_url, revisit, body in zip(*(batch.column(i).to_pylist() for i in range(7))):
                gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                held.append(gz.compress(record(page, url, digest, None if revisit else body.encode(), date, original, original_url)) + gz.flush())
                size += len(held[-1])
            if size >= file_bytes:
                yield flush()
        if held:
            yield flush()

    return work.save(rows.mapInArrow(write, "name string, n_records long"), "manifest")


def read_archives(spark: SparkSession, work: Workspace, manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; revisits resolved by a join."""
    folder = f"{work.path}/archives"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_id", "record_type", "refers_id", "payload_bytes", "payload_digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                for f, body in parse(files.get(folder, name)):
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if f["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"{f['WARC-Record-ID']} of {name} doesn't have its digest")
                    out.append((int(f["X-Page-Id"]) if "X-Page-Id" in f else None, f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Refers-To"), len(body), digest))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    listed = manifest.select("name").repartition(spark.sparkContext.defaultParallelism * 2)
    found = work.save(listed.mapInArrow(read, "page_id long, record_id string, record_type string, refers_id string, payload_bytes long, payload_digest string"), "records")
    responses, again = found.filter("record_type = 'response'"), found.filter("record_type = 'revisit'")
    originals = responses.dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("own_digest"))
    resolved = again.drop("payload_bytes").join(originals, "refers_id", "left").select("page_id", "payload_bytes", F.col("own_digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(resolved)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    work = Workspace(spark, "warc")
    return read_archives(spark, work, write_archives(pages, work))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN o ON o.payload_digest = p.payload_digest AND payload_bytes >= 100
"""
