"""Web archives of zstandard frames: a dictionary in the leading skippable frame, then one frame for each WARC record.

A task writes its partition's records into one archive in a shared folder, under another name first, so a repeated task leaves one
whole file. The reader takes an archive as a stream, loads the dictionary from the skippable frame, decodes one frame per
record, and checks the version line, that header fields are well formed, the lengths, the record's end and the payload's digest;
whatever is wrong raises ``WarcError``.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest page_id holds the payload (response); the
others point at it (revisit) and keep the HTTP header only, whose Content-Length is the full payload's.

Every archive has a dictionary: one trained on sample records, or where these are too few or too alike to train on, their content, or a
record without payload.

Defined results: a null payload is empty, a null url has no Target-URI. A null page_id is smaller than any other; rows that share
the largest page_id and the payload are all responses, and so are all where no page_id is known. A long payload is one record of
one frame, held in memory as a whole. An empty table gives an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import checkpoint, lean, shared_dir, table, utf8

#: Magic numbers of the format, fixed values: the skippable frame with the dictionary, and a frame.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_BYTES = 1000
#: Pages that train the dictionary, the longest of them, and the dictionary's bytes.
SAMPLE_PAGES, SAMPLE_CHARS, DICT_BYTES = 200, 16_384, 32_768
LEVEL, BLOCK, RESULT_ROWS = 3, 1 << 16, 4096
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: WARC-Date of all records: reruns give equal archives.
DATE = b"1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record or an archive that doesn't follow the format."""


class Record(NamedTuple):
    fields: dict[bytes, bytes]
    http: dict[bytes, bytes]
    payload: bytes


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary from sample records; if they are too few or too alike, the records themselves, as content without a header."""
    try:
        if len(samples) > 7:
            return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        pass
    return (b"".join(samples) or record(None, None, b"", "0" * 40))[:size]


def dictionary_sample(pages: DataFrame) -> list[bytes]:
    """Records of some different pages, the same at every run; only these pages' texts are gathered. pages: (page_id, url, html)."""
    key = F.xxhash64("page_id", "url")
    # of few bytes each, first those below a threshold, then the first of these; twice as many as wanted, for some pages are long
    share = 8 * SAMPLE_PAGES / max(1, pages.count())
    keys = pages.select(key.alias("key")).filter(F.pmod("key", F.lit(1 << 30)) < min(1 << 30, int(share * (1 << 30))))
    some = [x.key for x in keys.distinct().orderBy("key").limit(2 * SAMPLE_PAGES).collect()]
    short = pages.withColumn("key", key).filter(F.col("key").isin(some) & (F.octet_length("html") <= SAMPLE_CHARS))
    rows = short.groupBy("key").agg(F.min(F.struct("page_id", "url", "html")).alias("x")).collect()
    return [record(x.page_id, x.url, x.html.encode(), "0" * 40) for _, x in sorted(rows, key=lambda r: r.key)[:SAMPLE_PAGES]]


def _urn(page: int | None, payload_digest: str) -> bytes:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page} {payload_digest}'.encode()).hexdigest())}>".encode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """The bytes of a response or revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _urn(page, digest), b"WARC-Date: " + DATE]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    if page is not None:
        lines.append(b"Page-ID: %d" % page)
    if revisit:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _urn(refers_to, digest)]
        if refers_to is not None:
            lines.append(b"Refers-To-Page-ID: %d" % refers_to)
    lines += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(out: BinaryIO, records: Iterable[bytes], dictionary: bytes) -> int:
    """Writes the dictionary's frame, if there is a dictionary, and a frame per record; the number of records."""
    if dictionary:
        out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
    n = 0
    for x in records:
        out.write(compress(x))
        n += 1
    return n


def _frames(stream: BinaryIO) -> Iterator[bytes]:
    """The decoded content of each frame."""
    data, decoder = stream.read(BLOCK), None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        end = 8 + struct.unpack_from("<I", data, 4)[0]
        while len(data) < end and (more := stream.read(max(BLOCK, end - len(data)))):
            data += more
        if len(data) < end:
            raise WarcError("the dictionary is cut off")
        raw, data = data[8:end], data[end:]
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    decoder = decoder or zstandard.ZstdDecompressor()
    while data or (data := stream.read(BLOCK)):
        one, parts = decoder.decompressobj(), []
        try:
            while True:
                parts.append(one.decompress(data))
                if one.eof:
                    data = one.unused_data
                    break
                if not (data := stream.read(BLOCK)):
                    raise WarcError("a frame is cut off")
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        yield b"".join(parts)


def _fields(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header field: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _length(fields: dict[bytes, bytes]) -> int:
    value = fields.get(b"content-length", b"")
    if not value.isdigit():
        raise WarcError(f"not a length: {value[:80]!r}")
    return int(value)


def parse(data: bytes) -> Record:
    """One record, checked."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise WarcError(f"not a record: {data[:20]!r}")
    head, end, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    n = _length(fields)
    if not end or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, the header says {n}")
    for name in (b"warc-type", b"warc-record-id", b"warc-date"):
        if name not in fields:
            raise WarcError(f"{name.decode()} is missing")
    if not fields.get(b"content-type", b"").startswith(b"application/http"):
        return Record(fields, {}, rest[:n])
    top, end, payload = rest[:n].partition(b"\r\n\r\n")
    http = _fields(top)
    if not end or not top.startswith(b"HTTP/"):
        raise WarcError("not an HTTP message")
    if fields[b"warc-type"] == b"response":
        if len(payload) != _length(http):
            raise WarcError(f"the payload has {len(payload)} bytes, its header says {_length(http)}")
        if fields.get(b"warc-payload-digest") not in (None, b"sha1:" + hashlib.sha1(payload).hexdigest().encode()):
            raise WarcError("the payload's digest differs")
    return Record(fields, http, payload)


def read_archive(stream: BinaryIO) -> Iterator[Record]:
    return map(parse, _frames(stream))


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def references(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(id, refers_to) of the pages that revisit another. pages: (page_id, html)."""
    each = pages.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= least).drop("n")
    # a written table on either side lets Spark split the rows of a digest that many pages share
    groups = checkpoint(each.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n"))
    return each.join(groups, "digest").filter("page_id is null or page_id < refers_to").select(F.col("page_id").alias("id"), "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes all pages (page_id, url, html); (path, records) of the archives, kept in the checkpoint folder."""
    pages = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    dictionary = train_dictionary(dictionary_sample(pages))
    back = references(pages, least)
    rows = pages.withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    rows = rows.join(back.withColumnRenamed("digest", "_digest").distinct(), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "html", "digest", "refers_to", F.col("_digest").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = filesystem(folder)
        store.create_dir(base)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        own = f"{name}.{uuid.uuid4().hex}"

        def records() -> Iterator[bytes]:
            for batch in batches:
                columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), *(batch.column(k).to_pylist() for k in (3, 4, 5))]
                for x in zip(*columns, strict=True):
                    yield record(*x)

        with store.open_output_stream(own, compression=None) as out:
            n = write_archive(out, records(), dictionary)
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["path", "records"])

    return checkpoint(rows.mapInArrow(lean(run), "path string, records long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records of the archives."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def row(x: Record) -> tuple:
        number = lambda name: int(x.fields[name]) if name in x.fields else None
        return number(b"page-id"), _length(x.http), x.fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode(), x.fields[b"warc-type"].decode(), number(b"refers-to-page-id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, n = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for x in read_archive(stream):
                        rows.append(row(x))
                        n += 1
                        if len(rows) == RESULT_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                if n != expected:
                    raise WarcError(f"{path} has {n} records, {expected} were written")

    return archives.select("path", "records").mapInArrow(lean(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark) + "-warc"
    return read_archives(write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder), folder)


OP9_SQL = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM q
"""
