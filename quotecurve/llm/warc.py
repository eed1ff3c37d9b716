"""WARC records in ZIP archives: written by tasks, read by ranges without extraction.

An archive holds a stored member with the records, each compressed on its own, and a stored member with
their index. A reader parses the end record and the central directory (or their ZIP64 forms), takes the
index, and reads only the byte ranges of records.
"""

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotecurve.llm.common import ensure_checkpoint_dir, materialise, text_bytes

MIN_BYTES = 100  # shorter payloads are never revisits
ARCHIVE_BYTES = 64 << 20  # an archive is closed when its records reach this size
LEAST_BYTES, TASK_BYTES = 1 << 20, 64 << 20  # archive bytes that a reading task takes: at least, about, and at most, about
RANGE_BYTES = 4 << 20  # records of so many bytes are read by one task step
DATE = "2000-01-01T00:00:00Z"  # WARC-Date of written records
RECORDS, INDEX = "archive/records.warc.gz", "indexes/records.jsonl"
_ARCHIVES = "path string, records long, bytes long"
_RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


# ---------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (payload None) keeps the HTTP head of the full payload and no body."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    named = f"{page_id}|{url}|{digest}"
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, named)}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))).replace("%", ""))))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if payload is None:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("X-Refers-To-Page-ID", str(refers_to)))
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of one record."""
    from urllib.parse import unquote

    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[16:]) for line in http.decode().split("\r\n") if line.startswith("Content-Length: "))
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    full = field["WARC-Type"] == "response"
    if full and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of page {field.get('X-Page-ID')} does not match its digest")
    number = {name: int(field[name]) if name in field else None for name in ("X-Page-ID", "X-Refers-To-Page-ID")}
    url = unquote(field["WARC-Target-URI"]) if "WARC-Target-URI" in field else None
    return number["X-Page-ID"], url, field["WARC-Type"], payload if full else None, size, digest, number["X-Refers-To-Page-ID"]


# ---------------------------------------------------------------- archives


class _Archive:
    """A ZIP archive under construction."""

    def __init__(self, folder: str):
        self.path = f"{folder}/pages-{uuid.uuid4().hex}.zip"
        system, place = pafs.FileSystem.from_uri(self.path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.member.write(packed)
        self.index.append((self.size, len(packed)))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            for offset, length in self.index:
                member.write(json.dumps({"offset": offset, "length": length}).encode() + b"\n")
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index), self.size


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """{name: (first byte, bytes)} of the stored members of a ZIP file; read(offset, length) gives its bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP end record")
    entries, length, start = struct.unpack("<H2I", tail[end + 10 : end + 20])
    locator = tail[end - 20 : end] if end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        (at,) = struct.unpack("<Q", locator[8:16])
        entries, length, start = struct.unpack("<3Q", read(at, 56)[32:56])
    directory, place, found = read(start, length), 0, {}
    for _ in range(entries):
        if directory[place : place + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, full, n_name, n_extra, n_note = struct.unpack("<10xH8x2I3H", directory[place : place + 34])
        (header,) = struct.unpack("<I", directory[place + 42 : place + 46])
        name = directory[place + 46 : place + 46 + n_name].decode()
        extra = directory[place + 46 + n_name : place + 46 + n_name + n_extra]
        wide = [full == 0xFFFFFFFF, packed == 0xFFFFFFFF, header == 0xFFFFFFFF]
        while len(extra) >= 4 and any(wide):
            kind, held = struct.unpack("<2H", extra[:4])
            if kind == 1:
                values = iter(struct.unpack(f"<{sum(wide)}Q", extra[4 : 4 + 8 * sum(wide)]))
                full, packed, header = (next(values) if w else v for w, v in zip(wide, (full, packed, header), strict=True))
                break
            extra = extra[4 + held :]
        if method == 0:
            found[name] = (header, packed)
        place += 46 + n_name + n_extra + n_note
    return found


def member_start(read, header: int) -> int:
    """First byte of a member's data, from its local header."""
    local = read(header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    n_name, n_extra = struct.unpack("<2H", local[26:30])
    return header + 30 + n_name + n_extra


def _reader(path: str):
    system, place = pafs.FileSystem.from_uri(path)
    file = system.open_input_file(place)
    return file, lambda offset, length: file.read_at(length, offset)


# ---------------------------------------------------------------- jobs


def record_types(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows (page_id, url, digest, size, payload, refers_to); payload is null for revisits.

    The full payload of a large group of copies is dropped before anything is written; the join on a
    digest with many rows is a plain one that adaptive execution can split.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.sha2(html, 256).alias("digest"),
        F.octet_length(html).cast("long").alias("size"),
        html.alias("html"),
    )
    first = rows.where(F.col("size") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "digest", "size", F.when(~again, F.col("html")).alias("payload"), F.when(again, F.col("first")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write one record per row; rows (path, records, bytes) tell the finished archives.

    Of rows with equal payloads of at least 100 bytes, those with the smallest id are responses and the
    others revisits of it; smaller payloads are all responses. A null payload is empty, a null url is left
    out, a null id is a revisit where its payload has a page with an id. Repeated rows are records each. An empty
    table gives no archive. An archive has a name of its own for each attempt of a task, and counts only
    when the task has ended, so a lost executor leaves at most an unnamed file. `folder` must be reachable
    from all executors; it is a new one in the shared checkpoint folder by default.
    """
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5)]
            for at, (page, url, digest, size, refers) in enumerate(zip(*columns, strict=True)):
                payload = text_bytes(batch.column(4).slice(at, 1))[0] if refers is None else None
                archive = archive or _Archive(folder)
                archive.add(record(page, url, digest, size, payload, refers))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        names = ["path", "records", "bytes"]
        columns = zip(*done, strict=True) if done else ([], [], [])
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return materialise(record_types(pages, id_col, url_col, html_col).mapInArrow(work, _ARCHIVES), "archives")


def record_index(archives: DataFrame) -> DataFrame:
    """Rows (path, offset, length): where each record of the archives lies in its file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file, read = _reader(path)
                with file:
                    held = members(read, file.size())
                    base = member_start(read, held[RECORDS][0])
                    lines = read(member_start(read, held[INDEX][0]), held[INDEX][1]).splitlines()
                entries = [json.loads(line) for line in lines]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(entries), pa.string()),
                        pa.array([base + e["offset"] for e in entries], pa.int64()),
                        pa.array([e["length"] for e in entries], pa.int64()),
                    ],
                    names=["path", "offset", "length"],
                )

    return archives.select("path").mapInArrow(work, "path string, offset long, length long")


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows (page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of all records.

    Payloads are checked against their digests; a damaged record fails the job. Neighbouring records are
    read with one request of a few megabytes at most.
    """

    def ranges(batch: pa.RecordBatch) -> Iterator[list[tuple[str, int, int]]]:
        held: list[tuple[str, int, int]] = []
        for entry in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if held and (entry[0] != held[0][0] or entry[1] != sum(held[-1][1:]) or entry[1] + entry[2] - held[0][1] > RANGE_BYTES):
                yield held
                held = []
            held.append(entry)
        if held:
            yield held

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        names = [part.split()[0] for part in _RECORDS.split(", ")]
        for batch in batches:
            for entries in ranges(batch):
                start = entries[0][1]
                file, read = _reader(entries[0][0])
                with file:
                    data = read(start, sum(entries[-1][1:]) - start)
                rows = [parse_record(gzip.decompress(data[o - start : o - start + n])) for _, o, n in entries]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    index = record_index(archives)
    stretch = (F.col("offset") / RANGE_BYTES).cast("long")
    size = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    busy = min(2 * archives.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES)
    parts = max(1, busy, -(-size // TASK_BYTES))  # by the records' bytes: index rows are too small to tell
    return index.repartition(parts, "path", stretch).sortWithinPartitions("path", "offset").mapInArrow(work, _RECORDS)
