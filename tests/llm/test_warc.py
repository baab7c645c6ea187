import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter

import pytest
from edge_cases import words
from pyarrow import fs as arrow_fs

from scorecraft.llm import warc

PAGES = "page_id long, url string, html string, path string, records long, digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, min_bytes=0):
    groups = {}
    for page_id, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page_id is not None, page_id or 0))
    out = Counter()
    for payload, ids in groups.items():
        ids.sort(reverse=True)
        best = ids[0][1] if ids[0][0] else None
        for place, (known, page_id) in enumerate(ids):
            revisit = place > 0 and len(payload) >= min_bytes
            out[(page_id if known else None, len(payload), digest(payload), "revisit" if revisit else "response", best if revisit else None)] += 1
    return out


ROWS = (
    [(i, f"http://x.example/{i}", words(i, 20)) for i in range(60)]
    + [(100 + i, "http://copy.example/", "the same page") for i in range(70)]
    + [(200, None, None), (201, "", ""), (202, "http://a b\r\nc/\x01", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"),
       (None, "http://n/", "the same page"), (None, None, "only here"), (None, None, "only here"), (203, "u", "short"), (204, "u", "short"),
       (205, "ü", words(9, 40_000)), (206, "u", "ünï\x00\U0001f600\r\n\r\n"), (169, "http://copy.example/", "the same page")]
)


@pytest.fixture(scope="session")
def pages(spark, scratch):
    rows = [(*r, "x", 1, "y") for r in ROWS]
    return spark.read.parquet(scratch(spark.createDataFrame(rows, PAGES), 3))


def result(records):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect())


def files(index, column="archive"):
    return sorted({r[0] for r in index.select(column).collect()})


def content(path):
    fs, at = arrow_fs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as f:
        return f.read()


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip(pages, min_bytes):
    assert result(warc.round_trip(pages, min_bytes=min_bytes)) == brute(ROWS, min_bytes)


def test_streams_become_members_at_the_offsets_of_the_sidecar(pages):
    archives = warc.write_archives(pages, archive_bytes=20_000)
    assert sum(r.records for r in archives.collect()) == len(ROWS)
    for path in files(archives, "path"):
        inflate = zlib.decompressobj(31)
        inflate.decompress(content(path))
        assert inflate.eof and not inflate.unused_data  # one stream a file
    index = warc.normalise(archives)
    assert len(files(index)) == len(files(archives, "path")) > 1
    rows = {(r.archive, r.offset): r for r in index.collect()}
    for path in files(index):
        data, end = content(path), 0
        for line in content(f"{path}.idx").decode().splitlines():
            offset, length, kind, record_id = line.split("\t")
            assert int(offset) == end
            end += int(length)
            member = zlib.decompress(data[int(offset) : end], 31)
            assert member.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and member.endswith(b"\r\n\r\n")
            assert rows[(path, int(offset))].record_id == record_id
        assert end == len(data)
    assert result(warc.read_records(index)) == brute(ROWS)


def test_the_text_of_an_archive_is_kept(pages):
    archives = warc.write_archives(pages)
    before = Counter(gzip.decompress(content(p)) for p in files(archives, "path"))
    assert before == Counter(gzip.decompress(content(p)) for p in files(warc.normalise(archives)))


def test_other_writers_files():
    block = b"x" * 3_000_000
    plain = (b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nX-Long: one\r\n  two\r\nContent-Length: 3000000\r\n\r\n" + block
             + b"\r\n\r\n" + b"\r\nWARC/1.0\nWARC-Type: metadata\nContent-Length: 0\n\n\n\n")
    for data in (gzip.compress(plain), gzip.compress(plain[:100]) + gzip.compress(plain[100:])):
        out = io.BytesIO()
        index = list(warc.normalise_file(io.BytesIO(data), out))
        assert [i[2:] for i in index] == [("resource", "urn:a"), ("metadata", "")]
        first = zlib.decompress(out.getvalue()[: index[0][1]], 31)
        assert first.endswith(block + b"\r\n\r\n")
    for broken in (plain[:50], plain[:2000], b"no record"):
        with pytest.raises(ValueError):
            list(warc.normalise_file(io.BytesIO(gzip.compress(broken)), io.BytesIO()))
    with pytest.raises(EOFError):
        list(warc.normalise_file(io.BytesIO(gzip.compress(plain)[:-3000]), io.BytesIO()))


def test_changed_payload_is_noticed():
    page = (1, "u", b"payload", "11111111-1111-1111-1111-111111111111", None, None)
    record = warc.page_record(page, warc.DATE)
    assert warc.page_of(gzip.compress(record))[:3] == (1, "u", 7)
    with pytest.raises(ValueError):
        warc.page_of(gzip.compress(record.replace(b"payload", b"pAyload")))


def test_empty_table(spark, scratch):
    none = spark.read.schema(PAGES).parquet(scratch(spark.createDataFrame([], PAGES), 1))
    assert warc.round_trip(none).collect() == []
