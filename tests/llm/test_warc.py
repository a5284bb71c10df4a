import gzip
import hashlib
import io
import json
import zipfile

import pytest

from fundloom.llm import warc
from fundloom.llm.shared import new_path


def test_round_trip(spark):
    big = "<p>é\r\n\r\n" + "x" * 200
    rows = [(5, "http://a", big), (3, "http://b", big), (9, None, big), (1, "u\r\nv", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", big), (None, "n", "only" * 50), (None, "n", "only" * 50), (3, "http://b", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as digest", "3 as payload")
    folder = new_path(spark, "warc-test")
    archives = warc.write_archives(pages, folder, archive_bytes=300)
    assert archives.count() > 1
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    want = []
    for page, url, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 100 and html == big and page != 3
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None, None if revisit else body))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)
    assert warc.archived(pages.limit(0)).count() == 0


def opened(data: bytes):
    return (lambda at, n: data[at : at + n]), len(data)


def test_directories():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a/é.txt", b"hello")
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"w" * 10)
        z.writestr("packed", b"p" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK"
    read, size = opened(raw.getvalue())
    members = warc.directory(read, size)
    assert {name: m[2] > 0 for name, m in members.items()} == {"a/é.txt": False, "wide": False, "packed": True}
    for name, body in (("a/é.txt", b"hello"), ("wide", b"w" * 10)):
        place, n, _ = members[name]
        assert read(warc.data_start(read, place), n) == body


def test_zip64_directory():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:  # more members than 16 bits count
        for k in range(65_600):
            z.writestr(str(k), b"")
        z.writestr("last", b"found")
    read, size = opened(raw.getvalue())
    members = warc.directory(read, size)
    assert len(members) == 65_601
    place, n, _ = members["last"]
    assert read(warc.data_start(read, place), n) == b"found"


def test_zip64_extra_fields(monkeypatch):
    raw = io.BytesIO()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)  # sizes and places above it go to the extra fields
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("first", b"f" * 300)
        z.writestr("second", b"s" * 20)
    read, size = opened(raw.getvalue())
    for name, body in (("first", b"f" * 300), ("second", b"s" * 20)):
        place, n, _ = warc.directory(read, size)[name]
        assert read(warc.data_start(read, place), n) == body


def record(kind, rid, block, *more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 2020-02-02T00:00:00Z", *more, f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_package_of_others(spark, tmp_path):
    http = lambda body: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    kind = "Content-Type: application/http; msgtype=response"
    one = [record("warcinfo", "<urn:uuid:1>", b"software: x", "Content-Type: application/warc-fields"), record("response", "<urn:uuid:2>", http(b"<p>2"), "WARC-Target-URI: http://two", "WARC-Payload-Digest: sha1:ABC", kind), record("request", "<urn:uuid:3>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request")]
    two = [record("response", "<urn:uuid:4>", http(b"four" * 400_000), kind), record("revisit", "<urn:uuid:5>", b"", "WARC-Refers-To: <urn:uuid:4>"), record("metadata", "<urn:page:6>", b"m: 6")]
    three = [record("response", "<urn:page:7>", http(b"seven"), kind), record("response", "<urn:page:8>", http(b"eight"), kind)]
    packed = [gzip.compress(x) for x in three]
    lines = ["!meta {}", *(f"x 2020 {json.dumps({'filename': 'three.warc.gz', 'offset': str(sum(map(len, packed[:k]))), 'length': len(x)})}" for k, x in enumerate(packed))]
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("datapackage.json", "{}" * 100, zipfile.ZIP_DEFLATED)
        z.writestr("archive/one.warc", b"".join(one))
        z.writestr("archive/two.WARC.gz", b"".join(map(gzip.compress, two)))
        z.writestr("archive/three.warc.gz", b"".join(packed))
        z.writestr("indexes/i.cdxj", "\n".join(lines))
    uri = f"file://{tmp_path}/a.wacz"
    got = {r["record_id"]: r for r in warc.read_archives(spark.createDataFrame([(uri,)], "uri string")).collect()}
    assert {k: (r["record_type"], r["page_id"], r["payload_bytes"]) for k, r in got.items()} == {
        "<urn:uuid:1>": ("warcinfo", None, 11), "<urn:uuid:2>": ("response", None, 4), "<urn:uuid:3>": ("request", None, 18), "<urn:uuid:4>": ("response", None, 1_600_000),
        "<urn:uuid:5>": ("revisit", None, 0), "<urn:page:6>": ("metadata", 6, 4), "<urn:page:7>": ("response", 7, 5), "<urn:page:8>": ("response", 8, 5),
    }
    assert got["<urn:uuid:2>"]["url"] == "http://two" and bytes(got["<urn:page:8>"]["payload"]) == b"eight"
    with zipfile.ZipFile(tmp_path / "b.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/one.warc", b"".join(one))
    with pytest.raises(Exception, match="compressed in its package"):
        warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/b.wacz",)], "uri string")).collect()
