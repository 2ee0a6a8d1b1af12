"""Web archives in ZIP packages: written as WARC records, read back by ranges without extraction.

Each task writes packages to the shared folder: a ZIP file of two stored
members, ``archive/data.warc.gz`` (one gzip member for each record) and
``indexes/index.cdxj`` (one line for each record, with offset and length).
Equal payloads of MIN_BYTES or more are stored once; the others are revisit
records that refer to the one of the smallest page_id.

The reader parses the end-of-directory record, its ZIP64 form and the central
directory from the package's tail, finds both members by their local headers,
reads the index, and deals out ranges of records; each range is one read from
the package at a computed offset. Packages are opened through Arrow's file
systems, so the shared folder may be local, HDFS or an object store.

Defined results: null html is an empty payload; null url is an empty target;
rows without page_id are never referred to unless their whole group has none;
rows that repeat a page_id refer to it like others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored

MIN_BYTES, PER_PACKAGE, PER_RANGE = 100, 8192, 256
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
EPOCH = "2024-01-01T00:00:00Z"


def location(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# --- writing -------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit holds no payload but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if is_revisit else http + payload
    clean = re.sub(r"[\r\n]", " ", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_package(uri: str, records) -> int:
    """Stream (page_id, url, record) into a package; the name appears only when it is whole. Returns the record count."""
    system, path = location(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    lines, at = [], 0
    with system.open_output_stream(f"{path}.part") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(DATA, "w", force_zip64=True) as member:
            for page_id, url, raw in records:
                packed = gzip_member(raw)
                member.write(packed)
                lines.append(f"{json.dumps(url or '')} 20240101000000 " + json.dumps({"page": page_id, "offset": at, "length": len(packed)}))
                at += len(packed)
        with z.open(INDEX, "w", force_zip64=True) as member:
            for line in lines:
                member.write(line.encode() + b"\n")
    system.move(f"{path}.part", path)
    return len(lines)


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write a record for every page; returns the manifest (package, records) as a stored table."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    long_enough = F.octet_length("html") >= min_bytes
    # stored, so that a payload which very many pages share is a hot key of a plain join, which Spark can split
    firsts = rows.filter(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    firsts = stored(firsts, folder, "firsts")
    rows = rows.join(firsts, "digest", "left").select("page_id", "url", "html", "first")

    def run(batches):
        def records():
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for r in batch.slice(at, 64).to_pylist():
                        payload = r["html"].encode("utf-8", "surrogatepass")
                        revisit = r["first"] is not None and r["page_id"] != r["first"]
                        yield r["page_id"], r["url"], record(r["page_id"], r["url"], payload, r["first"], revisit)

        source, done = records(), False
        while not done:
            head = next(source, None)
            if head is None:
                return
            taken = [head]

            def some():
                nonlocal done
                yield taken.pop()
                for _ in range(PER_PACKAGE - 1):
                    if (r := next(source, None)) is None:
                        done = True
                        return
                    yield r

            name = f"{folder}/packages/{uuid.uuid4().hex}.wacz"
            n = write_package(name, some())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["package", "records"])

    return stored(rows.mapInArrow(run, "package string, records bigint"), folder, "manifest")


# --- reading -------------------------------------------------------------------------------------------------------


class Package:
    """Members of a ZIP file by name: where their stored bytes begin and how many there are."""

    def __init__(self, uri: str) -> None:
        system, path = location(uri)
        self.file = system.open_input_file(path)
        self.members = self._directory()

    def range(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _end(self) -> tuple[int, int, int]:
        """Place, size and entry count of the central directory, from the end record or its ZIP64 form."""
        total = self.file.size()
        tail_at = max(0, total - 65557)  # the end record and the longest comment
        tail = self.range(tail_at, total - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        count, size, place = struct.unpack_from("<10xHII", tail, at)
        if count == 0xFFFF or size == 0xFFFFFFFF or place == 0xFFFFFFFF:
            locator = self.range(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end64 = self.range(struct.unpack_from("<8xQ", locator)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, size, place = struct.unpack_from("<32xQQQ", end64)
        return place, size, count

    def _directory(self) -> dict[str, tuple[int, int]]:
        place, size, count = self._end()
        data, at, found = self.range(place, size), 0, {}
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, plain, names, extras, comments, header = struct.unpack_from("<10xH8xIIHHH8xI", data, at)
            name = data[at + 46 : at + 46 + names].decode()
            extra = data[at + 46 + names : at + 46 + names + extras]
            wide = self._wide(extra)
            # the ZIP64 field holds, in this order, only what did not fit
            plain = next(wide) if plain == 0xFFFFFFFF else plain
            packed = next(wide) if packed == 0xFFFFFFFF else packed
            header = next(wide) if header == 0xFFFFFFFF else header
            if method != 0 or packed != plain:
                raise ValueError(f"{name} is not stored")
            local = self.range(header, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("broken local header")
            own_names, own_extras = struct.unpack_from("<26xHH", local)
            found[name] = (header + 30 + own_names + own_extras, plain)
            at += 46 + names + extras + comments
        return found

    @staticmethod
    def _wide(extra: bytes):
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                yield from struct.unpack_from(f"<{n // 8}Q", extra, at + 4)
            at += 4 + n

    def index(self) -> list[tuple[int, int]]:
        """(offset, length) of each record within the data member, in order."""
        at, n = self.members[INDEX]
        lines = self.range(at, n).splitlines()
        entries = (json.loads(line[line.rindex(b" 20240101000000 ") + 16 :]) for line in lines)
        return [(e["offset"], e["length"]) for e in entries]


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a WARC record, and the payload of the HTTP message in its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload) of every record in the packages."""

    def plan(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                package = Package(name)
                base, entries = package.members[DATA][0], package.index()
                parts = [entries[k : k + PER_RANGE] for k in range(0, len(entries), PER_RANGE)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), pa.array([base + p[0][0] for p in parts], pa.int64()), pa.array([[n for _, n in p] for p in parts], pa.list_(pa.int64()))], names=["package", "at", "lengths"])

    def fetch(batches):
        for batch in batches:
            for r in batch.to_pylist():
                system, path = location(r["package"])
                with system.open_input_file(path) as f:
                    data, at, rows = f.read_at(sum(r["lengths"]), r["at"]), 0, []
                for n in r["lengths"]:
                    fields, payload = parsed(zlib.decompress(data[at : at + n], 31))
                    at += n
                    page, digest = _page(fields["WARC-Record-ID"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "revisit":
                        row = (page, int(fields["X-Payload-Length"]), digest, "revisit", _page(fields["WARC-Refers-To"]))
                    else:
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of page {page} is damaged")
                        row = (page, len(payload), digest, "response", None)
                    rows.append((*row, fields["WARC-Target-URI"], payload) if with_payload else row)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 7 if with_payload else 5]
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", url string, payload binary" if with_payload else "")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest.select("package").repartition(n).mapInArrow(plan, "package string, at bigint, lengths array<bigint>")
    return ranges.repartition(n).mapInArrow(fetch, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to packages and read all records back."""
    return read(write(pages, shared_folder(spark)))
