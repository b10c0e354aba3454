"""WARC archives: write as one gzip stream per file, normalise to a member per record with an index, read back.

`write_streams` leaves what many crawlers leave: files that are one gzip stream
from end to end, of which no record can be read without all before it.
`normalise` inflates each such stream once, front to back with one record in
memory, compresses every record as its own gzip member and writes members and
sidecar index in one Spark job, so Spark's committer makes either whole or
absent when executors are lost. `read_records` seeks by the index.

Members go through Spark's text writer, whose line separator is one zero byte:
a gzip member of a record under 16 MiB ends in a zero byte (the high byte of
its length), which the separator supplies; a longer one is followed by an empty
member that does. So a data file is a plain concatenation of gzip members.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.common import new_dir

CRLF = "\r\n"
#: Shorter payloads are never written as a revisit.
REVISIT_BYTES = 100
#: A normalised archive is closed once its members reach this many bytes.
ARCHIVE_BYTES = 16 << 20
WARC_DATE = "1970-01-01T00:00:00Z"
RECORD_ID = "<urn:page:%s>"


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{CRLF}{name}: "), value)).otherwise("")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def to_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """One WARC record per page as text (`record`), without the closing blank lines.

    Of pages with equal payloads of `least` bytes or more that with the smallest
    page_id is the response and the others revisit it; rows that repeat this id
    are responses as well. A null html is an empty payload. A page without an
    id is a response unless another page with an id has its payload. Line ends
    and other control characters of a url are percent-encoded; a null url is
    left out.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": F.sha2("payload", 256)})
    copies = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    rows = rows.join(copies.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F\\x7F]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))), _line("WARC-Date", F.lit(WARC_DATE)), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("first")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", F.octet_length("block").cast("string")),
    )
    return rows.withColumn("block", block).select(F.concat(head, F.lit(CRLF * 2), F.col("block")).alias("record"))


def write_streams(records: DataFrame, path: str) -> None:
    """Each partition as one gzip stream of WARC records."""
    records.select("record").write.option("compression", "gzip").option("lineSep", CRLF * 2).text(path)


def _records(lines: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a stream given as its lines between CRLFs."""
    for line in lines:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = [line, *itertools.takewhile(bool, lines)]
        size = next(int(x.split(b":", 1)[1]) for x in head if x.lower().startswith(b"content-length:"))
        block, held = [], -2
        while held < size:
            part = next(lines, None)
            if part is None:
                raise ValueError(f"the stream ends within a block of {size} bytes")
            block.append(part)
            held += 2 + len(part)
        if held != size:
            raise ValueError(f"a block of {held} bytes where its header says {size}")
        yield b"\r\n".join(head), b"\r\n".join(block)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split(CRLF)[1:])}


def _deflate(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _normaliser(most: int):
    fields = pa.schema([("archive", pa.string()), ("kind", pa.string()), ("seq", pa.int64()), ("value", pa.binary())])
    nothing = _deflate(b"")

    def lines(batches):
        for batch in batches:
            yield from zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True)

    def members(name, stream):
        """Rows of a stream's archives: each one's members, then its index."""
        number, offset, index = 0, 0, []
        for head, block in _records(stream):
            member = _deflate(head + b"\r\n\r\n" + block + b"\r\n\r\n")
            said = _fields(head)
            index.append(f"{said['warc-record-id']} {said['warc-type']} {offset} {len(member)}".encode())
            if member[-1]:
                member += nothing
            yield f"{name}-{number}", "data", len(index), member[:-1]
            offset += len(member)
            if offset >= most:
                yield from ((f"{name}-{number}", "index", i, x) for i, x in enumerate(index))
                number, offset, index = number + 1, 0, []
        yield from ((f"{name}-{number}", "index", i, x) for i, x in enumerate(index))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path, own in itertools.groupby(lines(batches), key=lambda x: x[0]):
            # Streams of one file name in two folders, or of names alike but for their dots, get archives of their own.
            name = re.sub(r"[^A-Za-z0-9-]", "-", path.rsplit("/", 1)[-1]) + "-" + xxhash.xxh3_64_hexdigest(path)
            for row in members(name, (x for _, x in own)):
                held.append(row)
                size += len(row[3])
                if size > 4 << 20 or len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), fields.types, strict=True)], schema=fields)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), fields.types, strict=True)], schema=fields)

    return work


def normalise(spark: SparkSession, source: str, target: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Rewrite the gzip streams of `source` as archives of one member per record, each with its index.

    `target`/archive=NAME/kind=data holds the members and kind=index, beside it,
    one entry per record: id, type, offset, length, divided by zero bytes.
    Files are read by Spark's text reader, whose gzip codec inflates a stream
    as it goes; a damaged record fails the job.
    """
    stream = spark.read.option("lineSep", CRLF).text(source)
    stream = stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    rows = stream.mapInArrow(_normaliser(archive_bytes), "archive string, kind string, seq long, value binary")
    # An archive's rows are in one task; the sort keeps them in stream order through the partitioned write.
    rows = rows.sortWithinPartitions("archive", "kind", "seq").select("archive", "kind", F.col("value").cast("string").alias("value"))
    rows.write.partitionBy("archive", "kind").option("lineSep", "\0").text(target)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """archive, record_id, record_type, offset, length of every record."""
    lines = spark.read.schema("value string, archive string, kind string").option("lineSep", "\0").text(path).where("kind = 'index'")
    parts = F.split("value", " ")
    return lines.select("archive", parts[0].alias("record_id"), parts[1].alias("record_type"), parts[2].cast("long").alias("offset"), parts[3].cast("long").alias("length"))


def _seek():
    fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def number(record_id):
        return int(m[1]) if record_id and (m := re.fullmatch(r"<urn:page:(-?\d+)>", record_id)) else None

    def read(content, entry):
        raw = zlib.decompress(content[entry["offset"] : entry["offset"] + entry["length"]], 31)
        head, _, block = raw.partition(b"\r\n\r\n")
        said, size = _fields(head), len(raw) - len(head) - 8
        if said["warc-record-id"] != entry["record_id"] or int(said["content-length"]) != size:
            raise ValueError(f"the index is wrong at {entry}")
        http, _, payload = block[:size].partition(b"\r\n\r\n")
        length, digest = int(_fields(http)["content-length"]), said["warc-payload-digest"].removeprefix("sha256:")
        kind = said["warc-type"]
        if kind == "response":
            if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"a damaged payload at {entry}")
        else:
            payload = None
        return number(said["warc-record-id"]), length, digest, kind, number(said.get("warc-refers-to")), said.get("warc-target-uri"), payload

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, entries in zip(batch.column("content"), batch.column("entries").to_pylist(), strict=True):
                content = content.as_buffer()
                for start in range(0, len(entries), 500):
                    rows = [read(content, e) for e in entries[start : start + 500]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.types, strict=True)], schema=fields)

    return work


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record, each inflated alone at its indexed place and checked against its digest.

    A revisit has the digest and length of the payload it stands for and a null payload.
    """
    # An archive is closed at a fixed size, so its entries and its bytes fit one row.
    entries = read_index(spark, path).groupBy("archive").agg(F.collect_list(F.struct("record_id", "offset", "length")).alias("entries"))
    data = spark.read.format("binaryFile").load(path).where("kind = 'data'").select(F.col("archive").cast("string").alias("archive"), "content")
    found = entries.join(data, "archive").select("content", "entries")
    return found.mapInArrow(_seek(), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` as gzip streams, normalise them, and read the archives back."""
    spark = pages.sparkSession
    streams, archives = new_dir(spark, "warc-streams"), new_dir(spark, "warc")
    write_streams(to_records(pages), streams)
    normalise(spark, streams, archives)
    if not read_index(spark, archives).limit(1).count():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
    return read_records(spark, archives)
