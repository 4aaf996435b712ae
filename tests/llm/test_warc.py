import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from cases import SF, needs_tables
from laneflow.llm import queries, warc
from laneflow.session import shared_dir

SCHEMA = "page_id bigint, url string, html string, payload string, sha1 string"


def test_directory_of_many_members():
    """More members than the plain end record can count."""
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as package:
        for i in range(66_000):
            package.writestr(f"{i}", b"%d" % i)
        package.comment = b"PK\x05\x06 in a comment"
    members = warc.read_directory(file, len(file.getvalue()))
    assert len(members) == 66_000
    for name in ("0", "65999"):
        file.seek(members[name].begin(file))
        assert file.read(members[name].size) == name.encode()


def test_wide_fields_of_one_member():
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as package, package.open("a", "w", force_zip64=True) as member:
        member.write(b"stored")
    member = warc.read_directory(file, len(file.getvalue()))["a"]
    file.seek(member.begin(file))
    assert file.read(member.size) == b"stored"


def test_what_is_no_package():
    for data in (b"", b"plain", b"PK\x05\x06" + b"\0" * 10):
        with pytest.raises(ValueError):
            warc.read_directory(io.BytesIO(data), len(data))
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("a", b"x" * 100)
    with pytest.raises(ValueError):
        warc.read_directory(file, len(file.getvalue()))["a"].begin(file)


def test_records_are_standard_gzip_and_zip(tmp_path):
    writer = warc.PackageWriter(f"file://{tmp_path}")
    writer.add("http://x/ y\r\nEvil: 1", warc.build_record(1, "http://x/ y\r\nEvil: 1", b"body\r\n\r\nrest", base64.b32encode(hashlib.sha1(b"body\r\n\r\nrest").digest()).decode(), 12, None, False))
    path = writer.close().removeprefix("file://")
    with zipfile.ZipFile(path) as package:
        assert package.testzip() is None and all(i.compress_type == 0 for i in package.infolist())
        record = gzip.decompress(package.read(warc.RECORDS))
    parsed = warc.parse_record(record)
    assert parsed["payload"] == b"body\r\n\r\nrest" and parsed["page_id"] == 1 and "\r\nEvil" not in record.decode()
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"rest", b"best"))


def round_trip(spark, rows, **options):
    pages = spark.createDataFrame(rows, SCHEMA)
    marked = warc.mark_revisits(pages, **{k: v for k, v in options.items() if k == "min_bytes"})
    packages = warc.write_packages(marked, shared_dir(spark, "warc"), package_bytes=options.get("package_bytes", warc.PACKAGE_BYTES))
    return warc.read_packages(packages, options.get("bundle_bytes", warc.BUNDLE_BYTES)).collect()


def test_awkward_pages(spark):
    rows = [(i, u, h, "?", "?") for i, u, h in [
        (1, "http://a", "same"), (2, None, "same"), (3, "http://c d", "same"), (4, "http://d", None), (5, "http://e", ""), (6, "http://f", "é" * 3000),
        (None, "http://g", "same"), (7, "http://h", "twice"), (7, "http://h", "twice"), (None, "http://n", "lone"), (None, "http://n", "lone"),
    ]]
    out = round_trip(spark, rows, package_bytes=200, bundle_bytes=300)
    assert len(out) == len(rows)
    kind = lambda page, size: sorted((r["record_type"], r["refers_to"]) for r in out if r["page_id"] == page and r["payload_bytes"] == size)
    assert kind(3, 4) == [("response", None)] and kind(1, 4) == kind(2, 4) == [("revisit", 3)] and ("revisit", 3) in kind(None, 4)
    assert kind(5, 0) == [("response", None)] and kind(4, 0) == [("revisit", 5)] and kind(7, 5) == [("response", None)] * 2
    for r in out:
        if r["record_type"] == "response":
            assert base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"]
    assert {r["url"] for r in out if r["page_id"] == 2} == {None}
    assert all(r["record_type"] == "response" for r in round_trip(spark, rows, min_bytes=100_000))
    assert round_trip(spark, []) == []


@needs_tables
def test_query(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    keeper = {}
    for page, payload in pages.items():
        keeper[payload] = max(page, keeper.get(payload, page))
    rows = queries.QUERIES["op4_zip_packaged_warc"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        payload = pages[r["page_id"]]
        first = keeper[payload]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))
