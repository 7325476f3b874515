"""Web archives: WARC records in ZIP packages, written once and read by range without extraction.

Every page becomes a record. Of pages with equal payloads (by SHA-1), the one with the largest
id is stored as ``response``; all others become ``revisit`` records that name it and hold no
payload. Each task writes its records to packages of about ``package_bytes``: a ZIP archive
with a stored member ``archive/data.warc`` and a stored index ``indexes/index.cdx`` (a line per record:
place, length). Packages are written to the shared folder under names of their own per
attempt; the manifest of the writing job alone says which of them count.

The reader finds the end record, follows the ZIP64 locator where fields are full, walks the central
directory, resolves each member's place from its local header, and range-reads the index and then
single records. Compressed members are refused, not extracted. Each record's digest is checked.

Edge cases: a null html is an empty payload, and empty payloads are equal to each other; rows that
repeat the response's id are responses too; null ids are never referred to unless no other
row has the payload, and then all such rows are responses; null or odd URLs are written empty or
percent-encoded; other columns are ignored; an empty table gives no package and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierweave.llm.common import cut, new_folder
from tierweave.llm.storage import attempt_name, system

DATA, INDEX = "archive/data.warc", "indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"
END, END64, LOCATOR = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
ENTRY, LOCAL = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, response: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header block and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if not response:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields, its payload (None for a revisit) and the payload's stated length."""
    head, block = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    block = block[: int(fields["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    response = fields["warc-type"] == "response"
    if response and (len(payload) != stated or f"sha1:{digest(payload)}" != fields["warc-payload-digest"]):
        raise ValueError("a payload differs from its digest")
    page = lambda v: int(v.removeprefix("<urn:page:").rstrip(">")) if v and v != "<urn:page:>" else None
    return {"page_id": page(fields["warc-record-id"]), "payload_bytes": stated, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "record_type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to")), "payload": payload if response else None}


class Archive:
    """A ZIP archive behind ``read_at(size, place)``; members are given by their places, not extracted."""

    def __init__(self, file, size: int):
        self.file = file
        tail = max(0, size - (1 << 16) - END.size - LOCATOR.size)
        data = self.file.read_at(size - tail, tail)
        at = data.rfind(b"PK\x05\x06")
        while at >= 0 and (len(data) - at < END.size or at + END.size + END.unpack_from(data, at)[7] != len(data)):
            at = data.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end record")
        _, _, _, _, count, length, start, _ = END.unpack_from(data, at)
        if at >= LOCATOR.size and data[at - LOCATOR.size : at - LOCATOR.size + 4] == b"PK\x06\x07":
            where = LOCATOR.unpack_from(data, at - LOCATOR.size)[2]
            end = END64.unpack(self.file.read_at(END64.size, where))
            if end[0] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, start = (full if short == top else short for short, top, full in ((count, 0xFFFF, end[7]), (length, 0xFFFFFFFF, end[8]), (start, 0xFFFFFFFF, end[9])))
        self.members: dict[str, tuple[int, int]] = {}  # name -> place of its local header, length
        directory, at = self.file.read_at(length, start), 0
        for _ in range(count):
            entry = ENTRY.unpack_from(directory, at)
            if entry[0] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            packed, full, names, extras, comment, place = entry[8], entry[9], entry[10], entry[11], entry[12], entry[16]
            name = directory[at + ENTRY.size : at + ENTRY.size + names].decode()
            extra = directory[at + ENTRY.size + names : at + ENTRY.size + names + extras]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<2H", extra)
                if kind == 1:  # the full fields, in this order, of those that are at their top
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    full, packed, place = (next(wide) if v == 0xFFFFFFFF else v for v in (full, packed, place))
                extra = extra[4 + n :]
            if entry[4] == 0 and packed == full:
                self.members[name] = (place, full)
            at += ENTRY.size + names + extras + comment

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's data begins, and its length."""
        if name not in self.members:
            raise KeyError(f"no stored member {name}")
        header, length = self.members[name]
        local = LOCAL.unpack(self.file.read_at(LOCAL.size, header))
        if local[0] != b"PK\x03\x04":
            raise ValueError("a local header is damaged")
        return header + LOCAL.size + local[9] + local[10], length

    def read(self, name: str, at: int = 0, length: int | None = None) -> bytes:
        start, size = self.place(name)
        return self.file.read_at(size - at if length is None else length, start + at)


def _digests(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest`` of every row."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return own.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))


def write_archives(pages: DataFrame, package_bytes: int = 32 << 20, folder: str | None = None) -> DataFrame:
    """Write all pages; returns ``path, n_bytes, n_records`` of each package."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    own = _digests(pages)
    ids = cut(own.select("page_id", "sha1"), "warc-digests")
    first = ids.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    repeated = cut(first.where("n > 1").select("sha1", "refers_to"), "warc-repeated")
    # What is not its payload's response; the pages themselves are joined by their own id, which is never hot.
    later = ids.join(repeated, "sha1").where("not page_id <=> refers_to").select("page_id", "sha1", "refers_to").distinct()
    later = cut(later, "warc-revisits").withColumn("revisit", F.lit(True))
    same = own["page_id"].eqNullSafe(later["page_id"]) & (own["sha1"] == later["sha1"])
    rows = own.join(later, same, "left").select(own["page_id"], "url", "html", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = system(folder)
        filesystem.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        done: list[tuple[str, int, int]] = []
        data, lines = io.BytesIO(), []

        def close() -> None:
            name = attempt_name(base, part, ".wacz")
            with filesystem.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for member, content in ((DATA, data.getbuffer()), (INDEX, "".join(lines).encode())):
                    with z.open(zipfile.ZipInfo(member), "w", force_zip64=True) as f:
                        f.write(content)
                n = out.tell()
            done.append((f"{folder}/{name.rsplit('/', 1)[1]}", n, len(lines)))

        for b in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c for c in b.columns), strict=True):
                r = record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py(), not revisit.as_py())
                lines.append(f"{data.tell()} {len(r)}\n")
                data.write(r)
                if data.tell() >= package_bytes:
                    close()
                    data, lines = io.BytesIO(), []
        if lines:
            close()
        if done:
            sizes = filesystem.get_file_info([system(p)[1] for p, _, _ in done])
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in done]), pa.array([s.size for s in sizes], pa.int64()), pa.array([n for _, _, n in done], pa.int64())], ["path", "n_bytes", "n_records"])

    return cut(rows.mapInArrow(work, "path string, n_bytes long, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` and, if asked for, ``payload`` of every record."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                filesystem, own = system(path)
                with filesystem.open_input_file(own) as f:
                    z = Archive(f, size)
                    start, _ = z.place(DATA)
                    rows = []
                    for line in z.read(INDEX).decode().splitlines():
                        at, n = map(int, line.split())
                        rows.append(parse(f.read_at(n, start + at)))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=False)], names)
                            rows = []
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=False)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    own = manifest.select("path", "n_bytes")
    return own.repartition(max(1, min(own.count(), 100_000))).mapInArrow(work, schema)
