"""WARC records in ZIP-packaged archives, written and read back without extraction.

Pages become WARC records, each compressed by itself, in archives that are ZIP files with stored members: the records
(``archive/data.warc.gz``) and a CDXJ index of their places (``indexes/index.cdxj``). A page whose payload is the same as an
earlier page's is a revisit record that refers to it.

The reader takes any package: from its last bytes it finds the central directory (ZIP64 or not), locates all stored members
whose names end as archives (``.warc``, ``.warc.gz``) or indexes (``.cdxj``) do, and takes the places of records from the index lines
that name an archive; archives that no index names are walked record by record. Tasks then read ranges of records, not archives.
Packages lie in the shared folder and are opened through Arrow's file systems (local, HDFS, S3, ...).

Nulls and edge cases: a null html is an empty payload; a null url an empty target; a null ``page_id`` stays null and
never is the one that others refer to; repeated rows of the first page are responses each; payloads under
``least`` bytes are always responses; an empty table gives no archive and an empty result; other columns are ignored. In packages of
others, an archive that the ZIP file compresses is an error, other compressed members are left alone; records without an HTTP
response (``warcinfo``, ``request``, ``metadata``, ...) have their block as payload; record ids that aren't pages give a null ``page_id``.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import new_path, written

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: When records are said to be made: a parameter of the writer, so that the same pages give the same records.
DATE = "2000-01-01T00:00:00Z"
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20


# --- writing ---------------------------------------------------------------------------------------------------------


def record_types(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce("html", F.lit(""))
    told = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    # Only the digests that several pages have; the minimum is pre-aggregated, so a page that is everywhere is one row a task.
    shared = told.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    shared = written(shared, "warc-shared")
    joined = told.join(shared, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id, url, payload: bytes, digest, kind, refers_to) -> bytes:
    """One record, compressed by itself. A revisit keeps the HTTP header, with the length of the full payload, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def index_key(url: str) -> str:
    """The key of an index line: host labels from the top, then the path; no white space."""
    host, slash, path = url.partition("://")[2].lower().partition("/")
    return "".join(f"{','.join(reversed(host.partition(':')[0].split('.')))}){slash}{path}".split()) or "-"


class ArchiveWriter:
    """A ZIP file with the records member, then the index member, both stored."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        filesystem, path = fs.FileSystem.from_uri(self.uri)
        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = filesystem.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, url, record: bytes) -> None:
        self.member.write(record)
        said = {"url": url or "", "filename": RECORDS.rpartition("/")[2], "offset": str(self.at), "length": str(len(record))}
        self.index.append(f"{index_key(url or '')} {''.join(x for x in DATE if x.isdigit())} {json.dumps(said)}")
        self.at += len(record)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(INDEX, "".join(f"{x}\n" for x in sorted(self.index)))
        self.zip.close()
        self.file.close()
        return self.uri, len(self.index)


def archiver(folder: str, archive_bytes: int):
    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None
        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")), strict=True):
                now = now or ArchiveWriter(folder)
                now.add(url, warc_record(page_id, url, payload.encode(), digest, kind, refers_to))
                if now.at >= archive_bytes:
                    out, now = [*out, now.close()], None
        if now:
            out.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["uri", "records"])

    return archive


def write_archives(pages: DataFrame, folder: str, least: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """uri and records of the archives written. A task that is run again writes others; only those listed count."""
    return written(record_types(pages, least).mapInArrow(archiver(folder, archive_bytes), "uri string, records long"), "warc-archives")


# --- reading ---------------------------------------------------------------------------------------------------------


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file: name -> (place of the local header, size, compression; 0: stored). ``read(offset, n)``."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":  # the ZIP64 locator
        at = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        wide = read(at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    found, body, k = {}, read(start, length), 0
    for _ in range(count):
        if body[k : k + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_note, place = *struct.unpack("<H", body[k + 10 : k + 12]), *struct.unpack("<IIHHH", body[k + 20 : k + 34]), struct.unpack("<I", body[k + 42 : k + 46])[0]
        name = body[k + 46 : k + 46 + n_name].decode()
        extra, e = body[k + 46 + n_name : k + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:  # the 64-bit values, in this order, of the fields that are full
                wide, at = extra[e + 4 : e + 4 + n], 0
                values = []
                for v in (full, packed, place):
                    if v == 0xFFFFFFFF:
                        v, at = struct.unpack("<Q", wide[at : at + 8])[0], at + 8
                    values.append(v)
                full, packed, place = values
            e += 4 + n
        found[name] = (place, full, method)
        k += 46 + n_name + n_extra + n_note
    return found


def data_start(read, place: int) -> int:
    """Where a member's bytes start: after its local header, whose name and extra field have lengths of their own."""
    head = read(place, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return place + 30 + sum(struct.unpack("<HH", head[26:30]))


class Opened:
    """A file of Arrow's file systems to read ranges of, closed at the end of a ``with``."""

    def __init__(self, uri: str):
        filesystem, path = fs.FileSystem.from_uri(uri)
        self.file = filesystem.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def is_archive(name: str) -> bool:
    return name.lower().endswith((".warc", ".warc.gz"))


def walked(read, start: int, size: int, packed: bool) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of an archive without an index, which is read once in pieces."""
    at = 0
    while at < size:
        if packed:
            one, upto = zlib.decompressobj(wbits=31), at
            while not one.eof and upto < size:
                piece = read(start + upto, min(1 << 20, size - upto))
                one.decompress(piece)
                upto += len(piece) - len(one.unused_data)
            if not one.eof:
                raise ValueError("the last record of an archive is cut short")
            length = upto - at
        else:
            head = b""
            while b"\r\n\r\n" not in head and len(head) < size - at:
                head += read(start + at + len(head), min(1 << 16, size - at - len(head)))
            fields = header_fields(head.partition(b"\r\n\r\n")[0])
            length = min(head.index(b"\r\n\r\n") + 8 + int(fields["content-length"]), size - at)
        yield at, length
        at += length


def places(archive: Opened) -> Iterator[tuple[int, int]]:
    """(place in the package, length) of every record of all its archives, in order."""
    members = directory(archive.read, archive.size)
    starts = {}
    for name, (place, size, method) in members.items():
        if is_archive(name):
            if method:
                raise ValueError(f"archive {name} is compressed in its package, so it can't be range-read")
            starts[name] = (data_start(archive.read, place), size)
    short = {name.rpartition("/")[2]: name for name in starts}
    found: dict[str, set] = {}
    for name, (place, size, method) in members.items():
        if name.lower().endswith(".cdxj") and not method:
            for line in archive.read(data_start(archive.read, place), size).decode().splitlines():
                said = line[line.index("{") :] if "{" in line else ""
                if said and not line.startswith("!"):
                    x = json.loads(said)
                    member = x["filename"] if x["filename"] in starts else short.get(x["filename"].rpartition("/")[2])
                    if member:
                        found.setdefault(member, set()).add((int(x["offset"]), int(x["length"])))
    for name, (start, size) in starts.items():
        for offset, length in sorted(found[name]) if name in found else walked(archive.read, start, size, name.lower().endswith(".gz")):
            yield start + offset, length


def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of about ``RANGE_BYTES`` of neighbouring records of each package: uri, start, lengths of the records."""
    for batch in batches:
        out = []
        for uri in batch.column("uri").to_pylist():
            with Opened(uri) as archive:
                start, lengths, stop = None, [], 0
                for at, length in places(archive):
                    if start is not None and (stop - start >= RANGE_BYTES or stop != at):
                        out.append((uri, start, lengths))
                        start, lengths = None, []
                    start = at if start is None else start
                    lengths.append(length)
                    stop = at + length
                if lengths:
                    out.append((uri, start, lengths))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["uri", "start", "lengths"])


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a WARC or HTTP header, names in lower case; what stands in the first line is not among them."""
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}


def page_of(record: str | None) -> int | None:
    said = (record or "").strip("<>").removeprefix("urn:page:")
    return int(said) if said.lstrip("-").isdigit() else None


def parsed(raw: bytes) -> dict:
    """A record's fields and payload; the payload of a response must have the SHA-256 digest that it names, if it names one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = header_fields(head)
    kind, block = fields["warc-type"], rest[: int(fields["content-length"])]
    named = fields.get("warc-payload-digest", "")
    digest = named.removeprefix("sha256:") if named.startswith("sha256:") else None
    payload, full = block, len(block)
    if fields.get("content-type", "").startswith("application/http") and kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        full = int(header_fields(http).get("content-length", len(payload)))
        if kind == "response":
            own = hashlib.sha256(payload).hexdigest()
            # A server's length may be that of a coded body; ours, and the digest, must be right.
            if digest not in (None, own) or (digest and full != len(payload)):
                raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
            digest, full = own, len(payload)
    elif kind != "revisit":
        digest = hashlib.sha256(payload).hexdigest()
    return {"page_id": page_of(fields["warc-record-id"]), "record_id": fields["warc-record-id"], "url": fields.get("warc-target-uri"), "payload": None if kind == "revisit" else payload, "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to"))}


READ = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def range_reader(columns: list[str]):
    schema = pa.schema([READ.field(c) for c in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("uri", "start", "lengths")), strict=True):
                with Opened(uri) as archive:
                    raw, rows = io.BytesIO(archive.read(start, sum(lengths))), []
                for n in lengths:
                    one = raw.read(n)
                    rows.append(parsed(zlib.decompress(one, wbits=31) if one[:2] == b"\x1f\x8b" else one))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in columns], schema=schema)

    return read


def read_archives(archives: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Records of the archives whose ``uri`` a table lists; the fields of ``READ``, or some of them."""
    columns = columns or READ.names
    kinds = {"page_id": "long", "record_id": "string", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}
    many = archives.sparkSession.sparkContext.defaultParallelism
    ranges = written(archives.select("uri").repartition(many).mapInArrow(located, "uri string, start long, lengths array<long>"), "warc-ranges")
    # A range is a few bytes here and megabytes of work, so the number of tasks is stated and not left to sizes.
    tasks = max(many, ranges.count() // 8)
    return ranges.repartition(tasks, "uri", "start").mapInArrow(range_reader(columns), ", ".join(f"{c} {kinds[c]}" for c in columns))


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages into archives of the shared folder and read them back: what each record says."""
    archives = write_archives(pages, new_path(pages.sparkSession, "warc"))
    return read_archives(archives, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
