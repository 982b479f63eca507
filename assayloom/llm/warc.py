"""Web archives: write pages as WARC records, read archives sequentially.

A record is a gzip member of its own. The reader never holds more than a block of
a file and one record: it decompresses a member piece by piece, frames the record
by its content length, and verifies the digests of block and payload. A payload
that another record of the archives already has is written as a revisit record:
the headers of the response without its body, and a reference to the other.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.common import saved
from assayloom.plans.storage import scratch_path

VERSION = b"WARC/1.1"
#: Bytes read from a file at once.
READ = 1 << 18
#: Tasks that read archives, at most; beyond that a task reads several, one after the other.
READERS = 20_000
#: Identical payloads shorter than this are written in full.
LEAST = 0
#: Bytes of payload after which a task starts a new archive.
ARCHIVE_BYTES = 256 << 20
#: Profile of a revisit by payload digest; a fixed value of the format.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(data: bytes) -> str:
    """SHA-1 as bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, whichever task writes it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _address(url: str | None) -> str:
    """An URL without white space and control characters; a null one is the empty ``urn:x-none:``."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]|") if url else "urn:x-none:"


def _line(name: str, value) -> bytes:
    return f"{name}: {value}\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit."""
    digest = base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", len(payload)) + b"\r\n"
    block = http if refers_to is not None else http + payload
    head = VERSION + b"\r\n" + _line("WARC-Type", "response" if refers_to is None else "revisit")
    head += _line("WARC-Record-ID", record_id(page_id, digest)) + _line("WARC-Date", date) + _line("WARC-Target-URI", _address(url))
    if page_id is not None:
        head += _line("Page-ID", page_id)
    if refers_to is not None:
        head += _line("WARC-Refers-To", record_id(refers_to, digest)) + _line("Refers-To-Page-ID", refers_to) + _line("WARC-Profile", SAME_PAYLOAD)
    head += _line("WARC-Payload-Digest", f"sha1:{digest}") + _line("WARC-Block-Digest", f"sha1:{base32(block)}")
    head += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", len(block))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _open(path: str):
    """(file system, path) of an address that every executor reaches, such as file:/ or hdfs://."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write(pages: DataFrame, folder: str, date: datetime | None = None) -> DataFrame:
    """Write rows (page_id, url, payload, refers_to) as archives in ``folder``; returns (path, records, bytes).

    Each task writes files of names that no other attempt uses. Only the rows
    returned by tasks that succeeded name archives, so what a lost executor left
    behind is never read. The table of archives is written at once: reading it
    again doesn't write archives again.
    """
    stamp = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, records, size, payloads, done = None, "", 0, 0, 0, []

        def close():
            nonlocal out, records, size, payloads
            if out is not None:
                out.close()
                done.append((path, records, size))
            out, records, size, payloads = None, 0, 0, 0

        for batch in batches:
            for page_id, url, payload, refers in zip(
                batch["page_id"].astype("Int64"), batch["url"], batch["payload"], batch["refers_to"].astype("Int64")
            ):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, name = _open(path)
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(name, compression=None)  # members are compressed already
                member = record(
                    None if page_id is pd.NA else int(page_id), url, bytes(payload), None if refers is pd.NA else int(refers), stamp
                )
                out.write(member)
                records, size, payloads = records + 1, size + len(member), payloads + len(payload)
                if payloads >= ARCHIVE_BYTES:
                    close()
        close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    rows = pages.select("page_id", "url", "payload", "refers_to")
    return saved(rows.mapInPandas(written, "path string, records long, bytes long"), "archives")


class Broken(ValueError):
    """An archive that isn't framed as it should be, or a digest that doesn't agree."""


def _members(stream) -> Iterator[bytes]:
    """The members of a gzip file one by one, decompressed a block at a time."""
    rest, unzip, parts = b"", None, []
    while True:
        data = rest or stream.read(READ)
        rest = b""
        if not data:
            break
        unzip = unzip or zlib.decompressobj(31)
        parts.append(unzip.decompress(data))
        if unzip.eof:
            rest = unzip.unused_data
            yield b"".join(parts)
            unzip, parts = None, []
    if unzip is not None:
        raise Broken("the last record is cut off")


def _headers(data: bytes) -> tuple[dict[str, str], int]:
    """Fields by lower-case name, and where the block starts."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Broken("a header without end")
    lines = data[:end].decode("utf-8").split("\r\n")
    fields = dict((name.strip().lower(), value.strip()) for name, _, value in (x.partition(":") for x in lines[1:]))
    return fields | {"": lines[0]}, end + 4


def parse(data: bytes) -> dict:
    """One record: its headers, block and payload, digests verified."""
    fields, start = _headers(data)
    if not fields[""].startswith("WARC/"):
        raise Broken("not a WARC record")
    stop = start + int(fields["content-length"])
    block = data[start:stop]
    if len(block) != stop - start or data[stop:] != b"\r\n\r\n":
        raise Broken("a record isn't as long as it says")
    if fields.get("warc-block-digest", f"sha1:{base32(block)}") != f"sha1:{base32(block)}":
        raise Broken("a block doesn't agree with its digest")
    http, body = _headers(block)
    payload = block[body:]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response" and (digest != base32(payload) or int(http["content-length"]) != len(payload)):
        raise Broken("a payload doesn't agree with its digest")
    page, refers = (fields.get(k) for k in ("page-id", "refers-to-page-id"))
    return {
        "page_id": None if page is None else int(page), "url": fields["warc-target-uri"], "record_id": fields["warc-record-id"],
        "record_type": fields["warc-type"], "payload_bytes": int(http["content-length"]), "payload_digest": digest,
        "refers_to": None if refers is None else int(refers), "payload": payload if fields["warc-type"] == "response" else None,
    }


def read(archives: DataFrame) -> DataFrame:
    """Records of the archives named by ``path``: one task reads a file from start to end.

    Columns: page_id, url, record_id, record_type, payload_bytes, payload_digest,
    refers_to and payload (null for revisits). A file that is cut off, or whose
    lengths or digests disagree, raises.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, name = _open(path)
                with system.open_input_stream(name, compression=None) as stream:
                    held, size = [], 0
                    for member in _members(stream):
                        held.append(parse(member))
                        size += len(member)
                        if size > 8 << 20:
                            yield frame(held)
                            held, size = [], 0
                    if held:
                        yield frame(held)

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    # archives have much the same size; up to a bound on tasks each has one of its own
    tasks = max(1, min(archives.count(), READERS))
    files = archives.select("path").repartitionByRange(tasks, "path")
    return files.mapInPandas(records, schema)


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, refers_to): which records are revisits, and of which page.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id
    is a response; a row with the same page_id and payload again is one too. Rows
    without page_id are revisits of a page that has one, else responses. A null
    html is an empty payload.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # counted within tasks first, so copies of a page don't meet in one; the join's large keys are split as it runs
    holders = rows.filter(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(holders.filter("n > 1").drop("n"), "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("holder")).alias("refers_to"))


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) as archives in the shared folder and read them back: ``read``'s columns.

    Other columns are not read; an empty table gives no record.
    """
    spark: SparkSession = pages.sparkSession
    return read(write(plan(pages, least), scratch_path(spark, "warc")))
