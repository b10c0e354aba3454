import gzip
import hashlib
import zlib
from pathlib import Path

import pytest
from studyloom.llm import warc

BIG = "<p>\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 90


def expected(rows):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(first.get(body, page), page)
    n = {}
    for _, _, html in rows:
        n[(html or "").encode()] = n.get((html or "").encode(), 0) + 1
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = body in first and n[body] > 1 and page != first[body]
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[body] if revisit else None))
    return out


@pytest.fixture(scope="module")
def rows():
    html = [BIG, BIG, "short", "short", None, "", "\r", "x\r\n", "\r\n" * 80, "z" * 99, "z" * 99, "z" * 100, "z" * 100, "\x1f\x8b\x00" * 50, "q" * 200_000]
    out = [(50 - i, f"http://a/{i}", h) for i, h in enumerate(html)]
    return [*out, (1, None, BIG), (2, "http://b/\r\nWARC-Type: x", "short"), (None, "u", "null id" * 20), (None, "u", BIG), (50, "http://a/0", BIG), (1, None, BIG)]


def test_round_trip(spark, rows):
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, size int")
    got = warc.round_trip(pages.repartition(3))
    key = lambda r: tuple((x is None, x) for x in r)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    found = got.collect()
    assert sorted((tuple(r[c] for c in cols) for r in found), key=key) == sorted(expected(rows), key=key)
    assert {r.url for r in found if r.page_id == 2} == {"http://b/%0D%0AWARC-Type: x"}
    bodies = sorted(bytes(r.payload) for r in found if r.record_type == "response")
    want = sorted((h or "").encode() for (_, _, h), e in zip(rows, expected(rows)) if e[3] == "response")
    assert bodies == want


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_are_plain_members_with_an_index(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_streams(warc.to_records(pages).coalesce(1), f"{tmp_path}/streams")
    stream = next(Path(tmp_path, "streams").glob("part-*.gz")).read_bytes()
    one = zlib.decompressobj(31)
    one.decompress(stream)
    assert one.eof and not one.unused_data  # a single gzip stream
    warc.normalise(spark, f"{tmp_path}/streams", f"{tmp_path}/archives", archive_bytes=1500)
    index = warc.read_index(spark, f"{tmp_path}/archives").collect()
    names = {r.archive for r in index}
    assert len(index) == len(rows) and len(names) > 2
    whole = b""
    for name in sorted(names, key=lambda n: int(n.rsplit("-", 1)[1])):
        data = next(Path(tmp_path, "archives", f"archive={name}", "kind=data").glob("part-*")).read_bytes()
        whole += gzip.decompress(data)  # any gzip reader takes the file
        for r in index:
            if r.archive == name:
                record = zlib.decompressobj(31)
                text = record.decompress(data[r.offset : r.offset + r.length])
                assert record.eof and not record.unused_data and r.record_id.encode() in text
    assert whole == gzip.decompress(stream)


def test_long_records_end_in_an_empty_member():
    member = warc._deflate(b"x" * (17 << 20))
    assert member[-1] != 0 and warc._deflate(b"")[-1] == 0
    lines = [b"WARC/1.1", b"WARC-Type: response", b"WARC-Record-ID: <urn:page:1>", f"Content-Length: {17 << 20}".encode(), b"", b"x" * (17 << 20), b""]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"path": ["f/part-1.txt.gz"] * len(lines), "value": pa.array(lines, pa.binary())})
    rows = [r for b in warc._normaliser(1 << 30)(iter([batch])) for r in b.to_pylist()]
    data = [r for r in rows if r["kind"] == "data"]
    assert len(data) == 1 and len(gzip.decompress(data[0]["value"] + b"\0")) > 17 << 20


@pytest.mark.parametrize("size", [2, 50])
def test_a_damaged_stream_fails(spark, tmp_path, size):
    bad = spark.createDataFrame([(f"WARC/1.1\r\nContent-Length: {size}\r\n\r\nabc",)], "record string")
    warc.write_streams(bad, f"{tmp_path}/s")
    with pytest.raises(Exception, match="bytes where its header says|the stream ends within"):
        warc.normalise(spark, f"{tmp_path}/s", f"{tmp_path}/a")


def test_streams_of_like_names_stay_apart(spark, rows, tmp_path):
    """Names alike up to a dot, and one name in two folders."""
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_streams(warc.to_records(pages).coalesce(1), f"{tmp_path}/made")
    stream = next(Path(tmp_path, "made").glob("part-*.gz")).read_bytes()
    for name in ("a/crawl.0001.warc.gz", "a/crawl.0002.warc.gz", "b/crawl.0001.warc.gz"):
        path = Path(tmp_path, "streams", name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(stream)
    warc.normalise(spark, f"{tmp_path}/streams/*", f"{tmp_path}/archives")
    index = warc.read_index(spark, f"{tmp_path}/archives").collect()
    assert len(index) == 3 * len(rows) and len({r.archive for r in index}) == 3
    for name in {r.archive for r in index}:
        data = next(Path(tmp_path, "archives", f"archive={name}", "kind=data").glob("part-*")).read_bytes()
        assert gzip.decompress(data) == gzip.decompress(stream)
        assert max(r.offset + r.length for r in index if r.archive == name) <= len(data) + 1
