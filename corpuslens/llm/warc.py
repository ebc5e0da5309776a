"""Web archives in ZIP packages: written once, read back by ranges without extraction.

A package is a ZIP file (ZIP64 where it must be) with two stored members: ``archive/data.warc.gz``,
one gzip member per record, and ``indexes/index.cdx``, one line per record with its place.  The
reader takes the end of the file, parses the (ZIP64) end record and the central directory, finds
the data of the stored members through their local headers, and reads records by range.

Files are opened through ``pyarrow.fs`` in the folder that all executors share.  A task writes to a
name of its own and renames at the end, so a lost or repeated task leaves no half package.

Cases: a null html is an empty payload; a null url leaves the header out; control characters in a
url are percent-encoded; rows that share the largest id of a group are all responses; a row without
an id is a response of its own; an empty table gives no package and no rows; other columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import steps
from corpuslens.session import durable, shared_folder

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 1000
#: Bytes of records in one package, and of neighbouring records in one range read.
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"

_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
_MANIFEST = "path string, bytes long, records long"
_RECORD = (
    "record_id string, page_id string, url string, record_type string, payload_bytes long,"
    " payload_digest string, refers_to string, payload binary"
)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{re.sub('^file:', '', path)}")


# ---- ZIP -----------------------------------------------------------------------------------------


class PackageWriter:
    """Stored members, written in a stream; sizes follow in the central directory."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes]) -> None:
        """Sizes and checksum stand in a descriptor behind the data (flag bit 3)."""
        start, crc, size = self.at, 0, 0
        raw = name.encode()
        self._put(struct.pack("<4sHHHHHIIIHH", _LOCAL, 45, 8, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)
        for part in parts:
            crc = zlib.crc32(part, crc)
            size += len(part)
            self._put(part)
        wide = self.zip64 or size >= 0xFFFFFFFF
        self._put(struct.pack("<4sIQQ" if wide else "<4sIII", b"PK\7\x08", crc, size, size))
        self.members.append((raw, start, crc, size))

    def close(self) -> None:
        first = self.at
        for raw, start, crc, size in self.members:
            wide = self.zip64 or max(start, size) >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if wide else b""
            shown = (0xFFFFFFFF,) * 3 if wide else (size, size, start)
            self._put(
                struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 8, 0, 0, 0x21, crc, *shown[:2], len(raw), len(extra), 0, 0, 0, 0, shown[2])
                + raw + extra
            )
        size, n = self.at - first, len(self.members)
        wide = self.zip64 or max(first, size) >= 0xFFFFFFFF or n >= 0xFFFF
        if wide:
            end64 = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, first))
            self._put(struct.pack("<4sIQI", _LOCATOR, 0, end64, 1))
        shown = (0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) if wide else (n, n, size, first)
        self._put(struct.pack("<4sHHHHIIH", _END, 0, 0, *shown, 0))


class PackageReader:
    """Places of the stored members of a ZIP file, from its tail and headers alone."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self.read(max(0, size - 65_557), min(size, 65_557))
        at = tail.rfind(_END)
        if at < 0:
            raise ValueError("no end record: not a ZIP file")
        _, _, _, _, n, length, first, _ = struct.unpack_from("<4sHHHHIIH", tail, at)
        if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR:
            where = struct.unpack_from("<Q", tail, at - 12)[0]
            head = self.read(where, 56)
            if head[:4] != _END64:
                raise ValueError("broken ZIP64 end record")
            n, length, first = struct.unpack_from("<QQQ", head, 32)
        self.members: dict[str, tuple[int, int]] = {}
        directory, p = self.read(first, length), 0
        for _ in range(n):
            (sign, _, _, _, method, _, _, _, packed, whole, names, extras, notes, _, _, _, start) = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, p)
            if sign != _CENTRAL:
                raise ValueError("broken central directory")
            name = directory[p + 46 : p + 46 + names].decode()
            q, end = p + 46 + names, p + 46 + names + extras
            while q + 4 <= end:
                kind, long_ = struct.unpack_from("<HH", directory, q)
                if kind == 1:  # ZIP64: only the fields that do not fit, in this order
                    wide = list(struct.unpack_from(f"<{long_ // 8}Q", directory, q + 4))
                    whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    start = wide.pop(0) if start == 0xFFFFFFFF else start
                q += 4 + long_
            if method == 0:  # stored: can be read by range
                local = self.read(start, 30)
                names_, extras_ = struct.unpack_from("<HH", local, 26)
                self.members[name] = (start + 30 + names_ + extras_, whole)
            p = end + notes

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def range(self, member: str, start: int, length: int) -> bytes:
        first, size = self.members[member]
        if start < 0 or start + length > size:
            raise ValueError(f"{member} has {size} bytes")
        return self.read(first + start, length)


# ---- records -------------------------------------------------------------------------------------


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: str, url: str | None, kind: str, refers_to: str | None, payload: bytes, size: int, digest: str) -> bytes:
    """One WARC 1.1 record; a revisit has the headers of the full payload, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    heads = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
    ]
    if kind == "revisit":
        heads += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    heads.append(f"Content-Length: {len(block)}")
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; the digest of a response is taken from its payload again."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    else:
        payload = None
    return {
        "record_id": fields["WARC-Record-ID"], "page_id": fields.get("X-Page-ID"), "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest,
        "refers_to": fields.get("X-Refers-To-Page"), "payload": payload,
    }


# ---- Spark ---------------------------------------------------------------------------------------


def _write(folder: str, limit: int):
    def package(rows: list[tuple]) -> tuple[str, int, int]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        index: list[str] = []

        def records() -> Iterator[bytes]:
            at = 0
            for page, url, kind, refers, payload, size, digest in rows:
                raw = gzip.compress(record(page, url, kind, refers, payload, size, digest), 5, mtime=0)
                index.append(f"{at} {len(raw)}\n")
                at += len(raw)
                yield raw

        with store.open_output_stream(f"{root}/.{name}.tmp") as out:
            zipped = PackageWriter(out)
            zipped.member(DATA, records())
            zipped.member(INDEX, iter(["".join(index).encode()]))
            zipped.close()
            size = zipped.at
        store.move(f"{root}/.{name}.tmp", f"{root}/{name}.wacz")
        return f"{folder}/{name}.wacz", size, len(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in steps(batches, "html"):
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                page, url, kind, refers, html, digest = row
                payload = (html or "").encode()
                rows.append((page, url, kind, refers, payload if kind == "response" else b"", len(payload), digest))
                held += len(rows[-1][4])
                if held >= limit:
                    yield _listed([package(rows)])
                    rows, held = [], 0
        if rows:
            yield _listed([package(rows)])

    return run


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(("path", "bytes", "records"), map(list, zip(*rows)))))


def write_packages(pages: DataFrame, folder: str | None = None, *, min_bytes: int = MIN_REVISIT_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write all pages (page_id, url, html) and return the manifest: path, bytes, records."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce("html", F.lit(""))
    read = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    twice = (
        pages.filter(F.octet_length("html") >= min_bytes)
        .groupBy(F.sha1(F.col("html").cast("binary")).alias("digest"))
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "first")
    )
    again = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("first"))
    placed = read.join(twice, "digest", "left").select(
        F.col("page_id").cast("string"), "url",
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first").cast("string")).alias("refers"), "html", "digest",
    )
    return durable(placed.mapInArrow(_write(folder, package_bytes), _MANIFEST))


def _ranges(limit: int):
    """Manifest rows -> record ranges of about the limit, from the stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = opened(path)
                with store.open_input_file(at) as file:
                    zipped = PackageReader(file, size)
                    lines = zipped.range(INDEX, 0, zipped.members[INDEX][1]).decode().splitlines()
                found, held = [], []
                for start, length in (map(int, x.split()) for x in lines):
                    held.append((start, length))
                    if start + length - held[0][0] >= limit:
                        found.append(held)
                        held = []
                found += [held] if held else []
                yield pa.RecordBatch.from_pydict(
                    {"path": [path] * len(found), "bytes": [size] * len(found), "start": [x[0][0] for x in found], "sizes": [[s for _, s in x] for x in found]},
                    schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("start", pa.int64()), ("sizes", pa.list_(pa.int64()))]),
                )

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            store, at = opened(row["path"])
            with store.open_input_file(at) as file:
                raw = PackageReader(file, row["bytes"]).range(DATA, row["start"], sum(row["sizes"]))
            found, p = [], 0
            for size in row["sizes"]:
                found.append(parse_record(gzip.GzipFile(fileobj=io.BytesIO(raw[p : p + size])).read()))
                p += size
            yield pa.RecordBatch.from_pydict(
                {n: [x[n] for x in found] for n in names},
                schema=pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names]),
            )


def read_packages(manifest: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the packages listed as (path, bytes, ...); ids as strings."""
    cut = manifest.select("path", "bytes").mapInArrow(
        _ranges(range_bytes), "path string, bytes long, start long, sizes array<long>"
    )
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return cut.repartition(max(cores, 12), "path", "start").mapInArrow(_read, _RECORD)
