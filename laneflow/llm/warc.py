"""WARC records in ZIP packages: writing, and reading by range without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdx`` (a line per record: URL, date, offset and length), both
stored uncompressed by ZIP, so that a record is a byte range of the package.

The reader parses the end record, the ZIP64 records where the fields are full,
the central directory and the member's local header; then it reads the index
and, for each bundle of neighbouring records, one range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from laneflow.llm.common import fresh, materialise, small_batches, utf8
from laneflow.session import shared_dir

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# A package is closed beyond so many bytes; a bundle of records is read at once up to so many.
PACKAGE_BYTES = 64 << 20
BUNDLE_BYTES = 4 << 20
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
# Fixed values of the WARC format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The store behind a path of Spark's, as far as Arrow knows it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


# ------------------------------------------------------------- ZIP directories


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # where the local header begins

    def begin(self, file) -> int:
        """Where the data of a stored member begins: the local header has its own name and extra lengths."""
        if self.method:
            raise ValueError(f"{self.name} is compressed; only stored members can be read by range")
        file.seek(self.header)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{self.name}: no local header at {self.header}")
        return self.header + 30 + sum(struct.unpack("<HH", head[26:30]))


def read_directory(file, size: int) -> dict[str, Member]:
    """The members of a ZIP package by name, from its central directory.  ``file`` must seek and read."""
    tail_at = max(0, size - 22 - _FULL16 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = len(tail)
    while True:
        end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("not a ZIP package: no end record")
        if len(tail) >= end + 22 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
    count, length, start = struct.unpack_from("<HLL", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07" and (count == _FULL16 or _FULL32 in (length, start)):
        file.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        record = file.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where the locator points")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    file.seek(start)
    directory, at, members = file.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        size, full = struct.unpack_from("<LL", directory, at + 20)
        names, extras, comments = struct.unpack_from("<HHH", directory, at + 28)
        header = struct.unpack_from("<L", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, stop = at + 46 + names, at + 46 + names + extras
        while extra + 4 <= stop:
            tag, n = struct.unpack_from("<HH", directory, extra)
            if tag == 1:  # in this order, only the fields that are full: size, compressed size, header
                values = iter(struct.unpack_from(f"<{n // 8}Q", directory, extra + 4))
                full = next(values) if full == _FULL32 else full
                size = next(values) if size == _FULL32 else size
                header = next(values) if header == _FULL32 else header
            extra += 4 + n
        members[name] = Member(name, method, size, header)
        at = stop + comments
    return members


# --------------------------------------------------------------------- records


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, a response with its payload or a revisit with the header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {_DATE}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
    ]
    if not revisit:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The parts of a record; a response's payload must have the digest that its header states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't fit its digest")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


class PackageWriter:
    """Writes records into packages below a folder; a new one begins when one is full."""

    def __init__(self, folder: str, package_bytes: int = PACKAGE_BYTES):
        self.folder, self.limit, self.package = folder, package_bytes, None

    def add(self, url: str | None, record: bytes) -> str | None:
        """Append a record; the path of the package that this closed, if any."""
        if self.package is None:
            # Never the name of another attempt of the same task.
            self.path = f"{self.folder}/{uuid.uuid4().hex}.wacz"
            system, path = file_system(self.path)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.stream = system.open_output_stream(path)
            self.package = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
            self.member, self.at, self.index = self.package.open(RECORDS, "w", force_zip64=True), 0, []
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.member.write(data)
        stamp = _DATE.translate({ord(c): None for c in "-:TZ"})
        self.index.append(f"{(url or '-').replace(' ', '%20')} {stamp} {json.dumps({'offset': self.at, 'length': len(data)})}")
        self.at += len(data)
        return self.close() if self.at >= self.limit else None

    def close(self) -> str | None:
        if self.package is None:
            return None
        self.member.close()
        with self.package.open(INDEX, "w", force_zip64=True) as member:
            member.write("\n".join(self.index).encode())
        self.package.close()
        self.stream.close()
        self.package = None
        return self.path


def bundles(file, size: int, bundle_bytes: int = BUNDLE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """Runs of neighbouring records, from the index: where each begins in the package, and its records' lengths."""
    members = read_directory(file, size)
    index, base = members[INDEX], members[RECORDS].begin(file)
    file.seek(index.begin(file))
    places = sorted((e["offset"], e["length"]) for line in file.read(index.size).splitlines() for e in [json.loads(line.split(b" ", 2)[2])])
    begin, lengths = 0, []
    for offset, length in places:
        if lengths and (offset != begin + sum(lengths) or sum(lengths) + length > bundle_bytes):
            yield base + begin, lengths
            lengths = []
        if not lengths:
            begin = offset
        lengths.append(length)
    if lengths:
        yield base + begin, lengths


# ------------------------------------------------------------------ Spark jobs


def mark_revisits(pages: DataFrame, html: str = "html", page_id: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``payload``, ``payload_bytes``, ``sha1`` (hex), ``revisit`` and ``refers_to``.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with
    the largest page_id is the response and the others revisit it.  Rows that
    share that largest page_id are all responses; a null page_id is smaller than
    any number, and where a group has nothing else, all its rows are responses.
    Null html is an empty payload.  Groups are found by SHA-256, combined before
    the shuffle; only groups of two or more meet the pages again.
    """
    digest, keeper, copies, size = fresh(pages, "__digest", "__keeper", "__copies", "__size")
    new = ("payload", "payload_bytes", "sha1", "revisit", "refers_to")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    rows = pages.select(*kept, utf8(F.col(f"`{html}`")).alias("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn(digest, F.sha2("payload", 256))
    groups = (
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col(digest).alias(size))
        .agg(F.max(F.col(f"`{page_id}`")).alias(keeper), F.count(F.lit(1)).alias(copies)).where(F.col(copies) > 1)
    )
    joined = rows.join(groups, F.col(digest) == F.col(size), "left")
    revisit = F.col(keeper).isNotNull() & ~F.col(f"`{page_id}`").eqNullSafe(F.col(keeper))
    return joined.select(
        *kept, "payload", "payload_bytes", "sha1", revisit.alias("revisit"), F.when(revisit, F.col(keeper)).alias("refers_to")
    )


def write_packages(marked: DataFrame, folder: str, url: str = "url", page_id: str = "page_id", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the pages of :func:`mark_revisits` as packages below ``folder``; the written table of their paths.

    Each task writes packages of its own.  Their paths go through a table that
    Spark commits, so packages of attempts that failed are never read.
    """
    small_batches(marked.sparkSession)
    rows = marked.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "payload_bytes", "sha1", "revisit", "refers_to",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = PackageWriter(folder, package_bytes)
        row = lambda path: pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string())})
        for batch in batches:
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                record = build_record(r["page_id"], r["url"], r["payload"] or b"", digest, r["payload_bytes"], r["refers_to"], r["revisit"])
                if path := writer.add(r["url"], record):
                    yield row(path)
        if path := writer.close():
            yield row(path)

    return materialise(rows.mapInArrow(run, "path string"), "packages")


def read_packages(packages: DataFrame, bundle_bytes: int = BUNDLE_BYTES, payload: bool = True) -> DataFrame:
    """The records of the packages in column ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    With ``payload`` also the payload, null for revisits.  Bundles are dealt
    evenly over tasks, whatever package they are in.  No package gives no rows.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = file_system(path)
                size = system.get_file_info(place).size
                with system.open_input_file(place) as file:
                    found = list(bundles(file, size, bundle_bytes))
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(found), pa.string()), "start": pa.array([s for s, _ in found], pa.int64()),
                    "lengths": pa.array([n for _, n in found], pa.list_(pa.int64())),
                })

    parts = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payload else [])]
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, place = file_system(r["path"])
                with system.open_input_file(place) as file:
                    file.seek(r["start"])
                    data = file.read(sum(r["lengths"]))
                rows, at = [], 0
                for length in r["lengths"]:
                    rows.append(parse_record(zlib.decompress(data[at : at + length], 31)))
                    at += length
                yield pa.RecordBatch.from_pylist(rows, pa.schema(parts))

    located = packages.select("path").repartition(F.col("path")).mapInArrow(locate, "path string, start bigint, lengths array<bigint>")
    return located.repartition(F.xxhash64("path", "start")).mapInArrow(fetch, schema + (", payload binary" if payload else ""))


def archive_folder(spark) -> str:
    return shared_dir(spark, "warc")
