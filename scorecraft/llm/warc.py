"""WARC archives: written as one gzip stream a file, normalised to one member a
record with a sidecar offset index, and read back by offset.

:func:`write_archives` writes a record for each page. Of pages with equal
payloads one is the response, the others revisit it. Its archives are what a
plain ``gzip`` of a WARC file gives: one stream, of which no record can be read
alone. :func:`normalise` inflates such a file's stream once, from front to back,
rewrites every record as a gzip member of its own and notes where each lies, in
a sidecar file beside the archive (``.idx``: offset, length, type, record id)
and in the table it returns. :func:`read_records` reads members through the
sidecar's offsets, checks every payload against its digest, and gives the pages
back. The normaliser takes any WARC file in gzip, of one member or many.

Scale: equal payloads are found by a partial aggregate over (SHA-256, salt), so
that no task holds a group of copies, and pages are dealt by the same pair to
the writing tasks, each of which starts a new file after ``ARCHIVE_BYTES`` of
payload. Bodies are streamed in pieces of ``PIECE`` bytes when normalised; when
written and read, one record is in memory (and one Arrow batch of pages).

Files go to the shared folder of ``spark.checkpoint.dir`` (or ``folder``),
through Arrow's file systems: a local or mounted path, HDFS, S3 or GCS. Every
attempt of a task writes files of names of its own, and a written table lists
those of the attempts that ended: what a lost executor leaves is never read.

Defined cases: a null payload is empty; empty payloads are copies of each other
(``min_bytes`` 0); payloads of any length are kept whole. Of equal payloads the
largest page id is the response (null ids come last; of equal ids the later
row), and identical rows are a record each. A null id or url has no field in its
record and comes back null; control characters and spaces in a url are
percent-encoded. An empty table gives no records. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import file_backed, located, scratch_path, small_batches, stage

#: Payload bytes after which a writing task starts its next archive.
ARCHIVE_BYTES = 256 << 20
#: Parts that rows of equal payload are dealt into.
SALTS = 64
PIECE = 1 << 20
#: zlib levels of the first stream, which is read once, and of the members.
STREAM_LEVEL, MEMBER_LEVEL = 1, 6
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
BLANK = b"\r\n\r\n"

ARCHIVES = "path string, records long, payload_bytes long"
INDEX = "archive string, offset long, length long, warc_type string, record_id string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def field_text(value: str) -> str:
    """A header value in one line: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record; fields of no value are left out."""
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields if value is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + BLANK + block + BLANK


def page_record(page: tuple, date: str) -> bytes:
    """The record of ``id, url, payload, record id, response's record id and page
    id`` (no response: it is one itself)."""
    page_id, url, payload, own, refers, refers_page = page
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + BLANK
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{own}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else field_text(url)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("WARC-Profile", PROFILE if refers else None),
        ("WARC-Refers-To", f"<urn:uuid:{refers}>" if refers else None),
        ("Page-Id", page_id),
        ("Refers-To-Page-Id", refers_page if refers else None),
        ("Content-Type", HTTP_TYPE),
    ]
    return record_bytes(fields, http if refers else http + payload)


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return arrow_fs.FileSystem.from_uri(path)


def make_folder(folder: str) -> None:
    fs, at = opened(folder)
    fs.create_dir(at, recursive=True)


class ArchiveWriter:
    """One gzip stream over all records of a file."""

    def __init__(self, folder: str, date: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, at = opened(self.path)
        self.out = fs.open_output_stream(at, compression=None)
        self.zip = zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, 31)
        self.records = self.payload = 0
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                ("Content-Type", "application/warc-fields")]
        self.put(record_bytes(info, b"format: WARC File Format 1.1\r\n"))

    def put(self, data: bytes) -> None:
        self.out.write(self.zip.compress(data))

    def close(self) -> tuple[str, int, int]:
        self.out.write(self.zip.flush())
        self.out.close()
        return self.path, self.records, self.payload


def with_responses(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``id, url, payload, own, response, response_id`` of located ``pages``: a
    row's record id, and the record id and page id of its payload's response,
    null below ``min_bytes``."""
    keyed = pages.select(
        "id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
        F.md5(F.concat_ws("#", "__file", "__row").cast("binary")).alias("own"),
        F.pmod(F.xxhash64("__file", "__row"), F.lit(SALTS)).cast("int").alias("salt"),
        F.struct("id", "__file", "__row").alias("rank"),
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    cells = stage(
        keyed.filter(F.length("payload") >= min_bytes).groupBy("digest", "salt").agg(F.max("rank").alias("rank")), "warc"
    )
    best = cells.groupBy("digest").agg(F.max("rank").alias("best"))
    best = cells.join(best, "digest").select(
        "digest", "salt", F.col("best.id").alias("response_id"),
        F.md5(F.concat_ws("#", "best.__file", "best.__row").cast("binary")).alias("response"),
    )
    return keyed.drop("rank").join(best, ["digest", "salt"], "left").select(
        "id", "url", "payload", "own", "response", "response_id"
    )


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write a record for each page; returns the table of archives."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or scratch_path(spark, "warc-stream")
    backed = file_backed(pages.select(id_col, url_col, html_col))
    named = located(backed).toDF("id", "url", "html", "__file", "__row").withColumn("id", F.col("id").cast("long"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make_folder(folder)
        writer, done = None, []
        for batch in batches:
            known = lambda name: [None if pd.isna(x) else x for x in batch[name]]
            ids, answers = ([None if pd.isna(x) else int(x) for x in batch[c].astype("Int64")] for c in ("id", "response_id"))
            for page_id, url, payload, own, response, response_id in zip(
                ids, known("url"), batch["payload"], batch["own"], known("response"), answers
            ):
                refers = uuid.UUID(response) if response and response != own else None
                writer = writer or ArchiveWriter(folder, date)
                writer.put(page_record((page_id, url, bytes(payload), uuid.UUID(own), refers, response_id), date))
                writer.records, writer.payload = writer.records + 1, writer.payload + len(payload)
                if writer.payload >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pd.DataFrame(done, columns=["path", "records", "payload_bytes"]).astype({"path": str, "records": "int64", "payload_bytes": "int64"})

    return stage(with_responses(named, min_bytes).mapInPandas(write, ARCHIVES), "warc")


@dataclass
class Header:
    raw: bytes
    fields: dict[str, str]


def read_header(stream: io.BufferedReader) -> Header | None:
    """The next record's header, or None at the end; blank lines before it are
    passed over. Field names are in lower case, continued lines joined."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    raw, fields, name = [line], {}, ""
    while True:
        line = stream.readline()
        if not line:
            raise ValueError("the file ends in a record's header")
        raw.append(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return Header(b"".join(raw), fields)
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()


def pieces(stream: io.BufferedReader, size: int) -> Iterator[bytes]:
    """``size`` bytes of the stream, in pieces."""
    while size:
        piece = stream.read(min(size, PIECE))
        if not piece:
            raise ValueError("the file ends in a record's block")
        size -= len(piece)
        yield piece


def normalise_file(source, target) -> Iterator[tuple[int, int, str, str]]:
    """Rewrite the gzip stream ``source`` into ``target``, a member a record:
    ``offset, length, type, record id`` of each."""
    offset = 0
    with gzip.GzipFile(fileobj=source) as flat:
        stream = io.BufferedReader(flat, PIECE)
        while (header := read_header(stream)) is not None:
            member = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
            length = target.write(member.compress(header.raw)) or 0
            for piece in pieces(stream, int(header.fields["content-length"])):
                length += target.write(member.compress(piece)) or 0
            length += target.write(member.compress(BLANK) + member.flush()) or 0
            yield offset, length, header.fields.get("warc-type", ""), header.fields.get("warc-record-id", "").strip("<>")
            offset += length


def _dealt(archives: DataFrame) -> DataFrame:
    """One task an archive, as near as a deal by turns gives."""
    return archives.repartition(max(1, archives.count()))


def normalise(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """Normalise the archives of the column ``path``; returns the offset index of
    all new archives, whose sidecars hold the same."""
    folder = folder or scratch_path(archives.sparkSession, "warc")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make_folder(folder)
        for batch in batches:
            for path in batch["path"]:
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                (source_fs, source_at), (fs, at) = opened(path), opened(name)
                with source_fs.open_input_stream(source_at, compression=None, buffer_size=PIECE) as source:
                    with fs.open_output_stream(at, compression=None, buffer_size=PIECE) as target:
                        index = list(normalise_file(source, target))
                with fs.open_output_stream(f"{at}.idx", compression=None) as sidecar:
                    sidecar.write("".join(f"{o}\t{n}\t{kind}\t{rid}\n" for o, n, kind, rid in index).encode())
                rows = pd.DataFrame(index, columns=["offset", "length", "warc_type", "record_id"])
                rows.insert(0, "archive", name)
                yield rows.astype({"offset": "int64", "length": "int64"})

    return stage(_dealt(archives.select("path")).mapInPandas(rewrite, INDEX), "warc")


def page_of(member: bytes) -> tuple | None:
    """The page of a member: ``RECORDS``, or None for records of other types."""
    stream = io.BufferedReader(io.BytesIO(zlib.decompress(member, 31)))
    header = read_header(stream)
    fields = header.fields
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = stream.read(int(fields["content-length"])).partition(BLANK)
    declared = fields["warc-payload-digest"].removeprefix("sha1:")
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    if kind == "response" and (payload_digest(payload) != declared or len(payload) != length):
        raise ValueError(f"payload of {fields['warc-record-id']} is not the one written")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("page-id"), fields.get("warc-target-uri"), length, declared, kind, number("refers-to-page-id")


def read_records(index: DataFrame) -> DataFrame:
    """The pages of the normalised archives in ``index``, each member read alone
    at the offset that the archive's sidecar gives: ``RECORDS``."""
    archives = index.select("archive").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["archive"]:
                fs, at = opened(path)
                with fs.open_input_stream(f"{at}.idx", compression=None) as sidecar:
                    lines = sidecar.read().decode().splitlines()
                rows = []
                with fs.open_input_file(at) as archive:
                    for line in lines:
                        offset, length, kind, _ = line.split("\t")
                        if kind in ("response", "revisit"):
                            archive.seek(int(offset))
                            rows.append(page_of(archive.read(int(length))))
                found = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield found.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    return _dealt(archives).mapInPandas(read, RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Pages written, normalised and read back: ``RECORDS``."""
    return read_records(normalise(write_archives(pages, **options)))
