"""WARC archives with an index first: records are written with their offsets, and read back by byte range.

Each task writes its own archive, one gzip member a record, and returns one index row a record: archive, offset, length,
page, URL and digest. The index is stored before anything is read. A read sorts the index rows by archive and offset, joins
neighbouring ranges into few larger reads, and unpacks the records from them. Archives get a new name for each attempt
of a task, so a task that runs again can't touch records that the index names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import in_batches, new_folder, small

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
ARCHIVE_BYTES = 1 << 30
#: Ranges with a gap of at most GAP are read together, up to READ_BYTES at once.
GAP, READ_BYTES = 1 << 16, 4 << 20
#: Stored bytes that a task reads, on the average.
TASK_BYTES = 8 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length int, page_id long, url string, payload_digest string, record_type string"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that a path is in, and the path there: local folders, or what a URI names."""
    path = re.sub(r"^file:/*", "/", path)
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One WARC record, uncompressed, and its payload's digest."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    page = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n", digest


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""

    def headers(block: bytes) -> dict[str, str]:
        return dict(x.split(": ", 1) for x in block.decode().split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = headers(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, headers(http), payload


def _archive(folder: str):
    """Writes batches of pages as archives in a folder, and yields their index rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        out, name, offset = None, "", 0
        for batch in batches:
            ids, urls, refs = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            rows = []
            for i, html in enumerate(batch.column("html")):
                html = html.as_buffer().to_pybytes() if html.is_valid else b""
                raw, digest = record(ids[i], urls[i], html, refs[i])
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                packed = pack.compress(raw) + pack.flush()
                if out is None or offset + len(packed) > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, offset = store.open_output_stream(f"{root}/{name}", compression=None), 0
                out.write(packed)
                rows.append((name, offset, len(packed), ids[i], urls[i], digest, "response" if refs[i] is None else "revisit"))
                offset += len(packed)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of pages (page_id, url, html) in folder/archives, and the index, which is stored in folder/index.

    Of rows with equal payloads of at least REVISIT_BYTES those with the smallest page_id are responses, the others
    revisits of it. Null html: an empty payload. A row with a null page_id is a response that none refers to. Repeated rows
    get a record each; two rows of the smallest page_id are both responses. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    html = F.coalesce("html", F.lit("")).cast("binary")
    prints = rows.filter(F.col("page_id").isNotNull() & (F.octet_length(html) >= REVISIT_BYTES)).select("page_id", F.sha2(html, 256).alias("digest"))
    # Stored before the join, so that a payload with many pages can be split at run time.
    least = small(prints.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    # A repeated page_id may carry several payloads, so the digest is part of the key.
    revisits = small(prints.join(least, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct())
    ids = revisits.select(F.col("page_id").alias("again"), "digest", "refers_to")
    match = (rows.page_id == ids.again) & (F.sha2(html, 256) == ids.digest)
    marked = rows.join(ids, match, "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to")
    store, root = file_system(f"{folder}/archives")
    store.create_dir(root, recursive=True)
    marked.transform(in_batches, _archive(f"{folder}/archives"), INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _fetch(folder: str):
    """Reads the records that sorted index rows name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        source, name = None, None
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            i = 0
            while i < len(where):
                archive, start, length = where[i]
                j, stop = i + 1, start + length
                while j < len(where) and where[j][0] == archive and where[j][1] - stop <= GAP and where[j][1] + where[j][2] - start <= READ_BYTES:
                    stop, j = where[j][1] + where[j][2], j + 1
                if archive != name:
                    source, name = store.open_input_file(f"{root}/{archive}"), archive
                block = source.read_at(stop - start, start)
                yield _unpacked([block[o - start : o - start + n] for _, o, n in where[i:j]])
                i = j

    return read


def _unpacked(packed: list[bytes]) -> pa.RecordBatch:
    rows = []
    for member in packed:
        warc, http, payload = parse(zlib.decompress(member, 31))
        page, refers = (re.sub(r"<urn:page:(\d*|-\d+)>", r"\1", warc.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To"))
        kind, stored = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha256:")
        # What was stored with its payload is measured anew; a revisit tells of a payload that is stored elsewhere.
        size, digest = (len(payload), hashlib.sha256(payload).hexdigest()) if kind == "response" else (int(http["Content-Length"]), stored)
        if digest != stored:
            raise ValueError(f"page {page}: the archive holds {digest}, its header says {stored}")
        rows.append((int(page) if page else None, warc.get("WARC-Target-URI"), payload, size, digest, kind, int(refers) if refers else None))
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows, in whichever order, with payload and url as stored (url percent-encoded)."""
    where = index.select("archive", "offset", "length")
    # An index row says little about the bytes behind it, so the number of ranges goes by those, not by the size of the index.
    stored = where.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    where = where.repartitionByRange(max(1, -(-stored // TASK_BYTES)), "archive", "offset").sortWithinPartitions("archive", "offset")
    return where.transform(in_batches, _fetch(f"{folder}/archives"), RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    folder = new_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
