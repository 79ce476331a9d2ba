"""WARC derivatives: response records into linked metadata and plain-text conversion records.

A response gives two records of its own: ``metadata`` (application/warc-fields: the status and headers of the source,
its payload digest, title and outlinks) and ``conversion`` (text/plain: the visible text). Both name the response
in WARC-Refers-To, keep its WARC-Target-URI, WARC-Date and WARC-Payload-Digest, and carry a WARC-Block-Digest of
their own. Record ids derive from the response's id, so that a task that runs again writes the same records.
``member`` gives a record's bytes as a gzip member; members one after the other are a .warc.gz file. ``read_files``
streams files record by record, so that a task holds a record and not a file.

Defined cases: a null page is an empty payload, whose conversion is an empty block; a null URL leaves out
WARC-Target-URI; repeated rows give records of one id; a response without a record id gets none to refer to and is
derived from its digest; an HTTP block that doesn't parse has status 0 and counts as payload whole; an empty table
gives an empty result; other columns are ignored; pages of any length are read whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import uuid
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.cluster import BATCH_BYTES, bound_batches, map_arrow, ship, take
from weftgraph.llm.html_text import INLINE, VOID

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
DATE = "2024-01-01T00:00:00Z"
#: What ends a block and begins the next record.
SEAM = b"\r\n\r\nWARC/1."
QUIET = frozenset("script style noscript template".split())
RECORD = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(names))}>"


class Page(HTMLParser):
    """Title, outlinks and visible text lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title, self.quiet, self.in_title = "", "", False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text and self.in_title:
                self.title = self.title or text
            if text:
                self.lines.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.links += [" ".join(v.split()) for k, v in attrs if k == "href" and v]
        if self.quiet or tag in INLINE:
            return
        self.flush()
        self.in_title = tag == "title"
        if tag in QUIET:
            self.quiet = tag

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "a" or tag not in VOID and tag not in INLINE:
            self.handle_starttag(tag, attrs)
        elif tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if self.quiet:
            if tag == self.quiet:
                self.quiet = ""
        elif tag not in INLINE:
            self.flush()
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.parts.append(data)


def read_page(payload: str) -> Page:
    page = Page()
    page.feed(payload)
    page.close()
    page.flush()
    return page


def http_parts(block: bytes) -> tuple[int, list[tuple[str, str]], bytes]:
    """Status, headers and payload of an HTTP response block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    words = first.split(None, 2)
    if not gap or len(words) < 2 or not words[0].startswith("HTTP/") or not words[1].isdigit():
        return 0, [], block
    return int(words[1]), [(a.strip(), b.strip()) for a, _, b in (line.partition(":") for line in rest)], payload


def response(url: str | None, html: str | None, name: str) -> dict:
    """A response record for a page, as a crawler would have written it."""
    payload = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return {"warc_type": "response", "record_id": record_id("response", name, url or ""), "refers_to": None, "target_uri": url, "warc_date": DATE, "content_type": "application/http; msgtype=response", "payload_digest": digest(payload), "block_digest": digest(block), "content_length": len(block), "block": block}


def derive(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    status, headers, payload = http_parts(source["block"])
    page = read_page(payload.decode("utf-8", "replace"))
    known = source["payload_digest"] or digest(payload)
    fields = [("http-status", str(status)), *((f"http-{a.lower()}", b) for a, b in headers), ("source-payload-digest", known), ("source-block-digest", source["block_digest"] or digest(source["block"])), ("source-length", str(len(payload))), ("title", page.title), *(("outlink", x) for x in page.links)]
    blocks = [("metadata", "application/warc-fields", "".join(f"{a}: {b}\r\n" for a, b in fields).encode()), ("conversion", "text/plain; charset=utf-8", "\n".join(page.lines).encode())]
    return [{"warc_type": kind, "record_id": record_id(kind, source["record_id"] or known), "refers_to": source["record_id"], "target_uri": source["target_uri"], "warc_date": source["warc_date"], "content_type": content, "payload_digest": known, "block_digest": digest(block), "content_length": len(block), "block": block} for kind, content, block in blocks]


def header(record: dict) -> bytes:
    named = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    return ("WARC/1.1\r\n" + "".join(f"{a}: {' '.join(str(record[k]).split())}\r\n" for a, k in named if record[k] is not None) + "\r\n").encode()


def member(record: dict) -> bytes:
    """A record as a gzip member."""
    return gzip.compress(header(record) + record["block"] + b"\r\n\r\n", mtime=0)


def parse(data: bytes) -> dict | None:
    """The record that ``data`` begins with, or None if its header or block isn't all there."""
    gap = data.find(b"\r\n\r\n")
    if gap < 0:
        return None
    own = {a.strip().lower(): b.strip() for a, _, b in (line.partition(":") for line in data[:gap].decode("utf-8", "replace").split("\r\n")[1:])}
    size = int(own["content-length"]) if own.get("content-length", "").isdigit() else 0
    if len(data) < gap + 4 + size:
        return None
    return {"warc_type": own.get("warc-type"), "record_id": own.get("warc-record-id"), "refers_to": own.get("warc-refers-to"), "target_uri": own.get("warc-target-uri"), "warc_date": own.get("warc-date"), "content_type": own.get("content-type"), "payload_digest": own.get("warc-payload-digest"), "block_digest": own.get("warc-block-digest"), "content_length": size, "block": data[gap + 4 : gap + 4 + size]}


def read_records(parts: Iterable[bytes]) -> Iterator[dict]:
    """Records of a file that was cut at every SEAM. A seam inside a block belongs to the block: parts are joined until
    the record has the length that its header tells."""
    held, n = b"", 0
    for part in parts:
        held = held + SEAM + part if held else (SEAM[4:] + part if n else part)
        n += 1
        if record := parse(held):
            yield record
            held = b""
    if held and (gap := held.find(b"\r\n\r\n")) >= 0:  # cut short
        size = len(held) - gap - 4
        if record := parse(re.sub(rb"(?i)(\r\ncontent-length:)[^\r]*", rb"\g<1> %d" % size, held[:gap]) + held[gap:]):
            yield record


def _batch(records: list[dict], more: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.int64() if n == "content_length" else pa.binary() if n == "block" else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([*more.values(), *(pa.array([r[n] for r in records], t) for n, t in zip(names, types, strict=True))], names=[*more, *names])


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response record of ``responses`` (the columns of RECORD), with its other columns."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    others = [c for c in responses.columns if c not in names]

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64)
            found = [derive(r) for r in rows.select(names).to_pylist()]
            twice = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            yield _batch([r for x in found for r in x], {c: rows.column(c).take(twice) for c in others})

    fields = ", ".join([*(f"`{c}` {responses.schema[c].dataType.simpleString()}" for c in others), RECORD])
    return map_arrow(responses.where(F.col("warc_type") == "response"), run, fields)


def responses(pages: DataFrame) -> DataFrame:
    """page_id and a response record for each page of ``pages`` (page_id, url, html)."""

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64)
            yield _batch([response(u, h, str(i)) for i, u, h in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)], {"page_id": rows.column("page_id")})

    pages = take(pages, "page_id", "url", "html")
    return map_arrow(pages, run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, {RECORD}")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path and records of WARC files, compressed (.gz) or not, that Spark's readers can open.

    Spark reads and decompresses a file as a stream that is cut at the seams between records. Files are read by a
    session of their own, in which none is split, so that a block that holds a seam is put together again.
    """
    reader = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        reader.conf.set(key, str(1 << 60))
    rows = reader.read.option("lineSep", SEAM.decode()).text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((path, part) for batch in batches for path, part in zip(batch["path"].to_pylist(), batch["part"].to_pylist(), strict=True))
        for path, own in itertools.groupby(every, key=lambda x: x[0]):
            held: list[dict] = []
            size = 0
            for record in read_records(part for _, part in own):
                held.append(record)
                size += len(record["block"])
                if size > BATCH_BYTES or len(held) == 256:
                    yield _batch(held, {"path": pa.array([path] * len(held))})
                    held, size = [], 0
            if held:
                yield _batch(held, {"path": pa.array([path] * len(held))})

    ship(spark)
    bound_batches(reader)
    return rows.mapInArrow(run, f"path string, {RECORD}")


def members(records: DataFrame) -> DataFrame:
    """``records`` with each record's bytes as a gzip member."""
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([member(r) for r in rows.select(names).to_pylist()], pa.binary())], names=[*rows.schema.names, "member"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema), "member binary"])
    return map_arrow(records, run, fields)
