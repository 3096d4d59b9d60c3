"""WARC archives: written by tasks, read back by a reader that salvages damaged files.

Writing. Every task packs its pages into archives of about `ARCHIVE_BYTES`, one gzip member per
record, under names no other attempt uses. Only the names that successful tasks report form the
manifest, so what a lost or repeated attempt leaves behind is never read. Records of equal
payloads of at least `REVISIT_BYTES` bytes are stored once, by the smallest page_id (`response`);
the others are `revisit` records that name it. Payloads below that are always stored.

Reading. A record is taken when its member unpacks, its header has all fields, its length
matches and its payload has the digest it states. Otherwise the reader searches for the next
place where a member (or, in plain archives, a version line) starts a valid record, goes on from
there, and reports the bytes between as a gap.

A null html is an empty payload. A null url is written as an empty target. Null page_ids stay
null. Pages that repeat both id and payload are all responses, since each has the smallest id.
An empty table gives no archives. Payloads of any length are written; a record is never split,
so an archive holds at least one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.common import kept
from shelfindex.session import scratch_path

REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
MEMBER, VERSION, BREAK = b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 14

RECORD = (
    "archive string, start long, stop long, kind string, page_id long, target string, "
    "payload_bytes long, payload_digest string, refers_to long"
)


# --- writing ---------------------------------------------------------------------------------


def with_types(pages: DataFrame) -> DataFrame:
    """Pages with payload, its size and digest, the record type and the page it refers to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)}
    )
    shared = (
        sized.filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy(F.col("digest").alias("of_digest"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter((F.col("copies") > 1) & F.col("first_id").isNotNull())
    )
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return sized.join(shared, F.col("digest") == F.col("of_digest"), "left").select(
        "page_id",
        "url",
        "payload_bytes",
        "digest",
        F.when(later, F.col("first_id")).alias("refers_to"),
        F.when(~later, F.col("payload")).alias("payload"),
    )


def record(page_id, url, size, digest, refers_to, payload) -> bytes:
    """One uncompressed record; `payload` is None for a revisit."""
    name = "none" if page_id is None else str(page_id)
    block = HTTP + (payload or b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return VERSION + "\r\n".join(lines).encode() + BREAK + block + BREAK


def packed(data: bytes) -> bytes:
    """A gzip member; level 1, since members are many and read once."""
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def archive_writer(folder: str):
    """A function for mapInArrow that writes its rows as archives and yields their paths."""

    def save(store, root: str, data: bytearray) -> pa.RecordBatch:
        name = f"{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(bytes(data))
        return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"]})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        data = bytearray()
        for batch in batches:
            for row in batch.to_pylist():
                data += packed(
                    record(
                        row["page_id"], row["url"], row["payload_bytes"], row["digest"],
                        row["refers_to"], row["payload"],
                    )
                )
                if len(data) >= ARCHIVE_BYTES:
                    yield save(store, root, data)
                    data = bytearray()
        if data:
            yield save(store, root, data)

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write `pages` as archives below `folder`; the manifest of their paths."""
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    return kept(
        with_types(pages).mapInArrow(archive_writer(uri), "archive string"), "warc-manifest"
    )


# --- reading ---------------------------------------------------------------------------------


@dataclass
class Scan:
    """Records and gaps of one archive, as (start, stop, fields) and (start, stop)."""

    records: list = field(default_factory=list)
    gaps: list = field(default_factory=list)


FIELD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")
PAGE = re.compile(rb"<urn:page:(-?\d+|none)>")


def page_of(value: bytes | None) -> int | None:
    found = PAGE.fullmatch(value or b"")
    if found is None:
        raise ValueError("no page id")
    return None if found[1] == b"none" else int(found[1])


def parsed(data: bytes, at: int = 0) -> tuple[dict, int] | None:
    """The record that starts at `at` and where it stops, or None if anything is amiss."""
    if not data.startswith(VERSION, at):
        return None
    line = data.find(b"\r\n" + VERSION, at)  # no header of this writer holds one, however long
    head = data.find(BREAK, at, line if line >= 0 else len(data))
    if head < 0:
        return None
    fields = dict(FIELD.findall(data, at + len(VERSION), head + 2))
    try:
        length = int(fields[b"Content-Length"])
        size = int(fields[b"X-Payload-Length"])
        kind = fields[b"WARC-Type"].decode()
        digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
        page_id = page_of(fields[b"WARC-Record-ID"])
        refers_to = page_of(fields[b"WARC-Refers-To"]) if kind == "revisit" else None
        target = fields[b"WARC-Target-URI"].decode()
    except (KeyError, ValueError):
        return None
    block = head + len(BREAK)
    stop = block + length
    if kind not in ("response", "revisit") or length < 0 or data[stop : stop + 4] != BREAK:
        return None
    if kind == "response":
        payload = data[block + len(HTTP) : stop]
        if not data.startswith(HTTP, block) or len(payload) != size:
            return None
        if hashlib.sha256(payload).hexdigest() != digest:
            return None
    values = {
        "kind": kind, "page_id": page_id, "target": target, "payload_bytes": size,
        "payload_digest": digest, "refers_to": refers_to,
    }
    return values, stop + len(BREAK)


def unpacked(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at `at` and where it stops."""
    if not data.startswith(MEMBER, at):
        return None
    press, content, place = zlib.decompressobj(31), [], at
    try:
        while place < len(data) and not press.eof:
            content.append(press.decompress(data[place : place + CHUNK]))
            place += CHUNK
    except zlib.error:
        return None
    stop = min(place, len(data)) - len(press.unused_data)
    return (b"".join(content), stop) if press.eof else None


def member(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record in the gzip member at `at`; a member holds exactly one."""
    opened = unpacked(data, at)
    whole = opened and parsed(opened[0])
    return (whole[0], opened[1]) if whole and whole[1] == len(opened[0]) else None


def next_mark(data: bytes, at: int) -> int:
    """The next place from `at` on that looks like a member or a version line, or the end."""
    places = [place for mark in (MEMBER, VERSION) if (place := data.find(mark, at)) >= 0]
    return min(places, default=len(data))


def scan(data: bytes) -> Scan:
    """Read one archive from end to end, going on after every damaged place."""
    found, at = Scan(), 0
    while at < len(data):
        got = member(data, at) or parsed(data, at)
        if got:
            found.records.append((at, got[1], got[0]))
            at = got[1]
            continue
        start = at
        while got is None and at < len(data):
            at = next_mark(data, at + 1)
            got = member(data, at) or parsed(data, at)
        found.gaps.append((start, at))
    return found


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RECORD.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            seen = scan(content.as_py())
            rows = [{"start": a, "stop": b, **fields} for a, b, fields in seen.records]
            rows += [{"start": a, "stop": b, "kind": "gap"} for a, b in seen.gaps]
            columns = {name: [row.get(name) for row in rows] for name in names}
            columns["archive"] = [path.as_py()] * len(rows)
            yield pa.RecordBatch.from_pydict(
                columns,
                schema=pa.schema(
                    [
                        (name, pa.int64() if "long" in part else pa.string())
                        for name, part in zip(names, RECORD.split(", "), strict=True)
                    ]
                ),
            )


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Records and gaps (kind `gap`) of the archives that the manifest names.

    Files below `folder` that the manifest does not name are left out unread.
    """
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD)
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    wanted = manifest.select(F.element_at(F.split("archive", "/"), -1).alias("name"))
    return (
        files.join(wanted, name == F.col("name"), "left_semi")
        .select("path", "content")
        .mapInArrow(read_rows, RECORD)
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write `pages` as archives and read them back: records and gaps."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
