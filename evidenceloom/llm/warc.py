"""WARC archives whose records are compressed one by one with a common Zstandard dictionary.

A task writes one archive: first a skippable frame (magic 0x184D2A5D) that holds the dictionary, then a
frame for each record, so that a reader needs the file only and can start at any record. The dictionary
is trained on the archive's own first records, ``SAMPLE`` bytes of them at most; where these are too few to
train on, it is their plain content.

An archive begins with a ``warcinfo`` record. Of records with equal payloads of at least ``SMALLEST`` bytes, the one with the smallest page id is
``response``; the others are ``revisit`` records, which carry the HTTP header (with the length), the digest and
a reference (id, address) to that one, but no payload. Record ids are unique: those of rows that others refer to are made of page and digest,
all others have the row's number too. First ones are found from digests alone, by minimum with partial
aggregation; only then do the pages go to the tasks that write, a group of equal pages spread by Spark
over as many tasks as its size asks for. A task holds the sample and one record.

Defined results: a null payload is an empty one; a null id is no group's smallest (if all are null, all
are responses); rows that repeat the smallest id are all responses; null urls are left out; an
empty table writes no archive; further columns, also of the names used here, are left out.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import pick
from .shared import AtomicFile, opened, scratch, written

# Fixed values of the formats
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SMALLEST = 100
SAMPLE, DICTIONARY, LEVEL = 4 << 20, 110 << 10, 3


def record_id(page_id: int | None, digest: str, number: int | None) -> str:
    """number: the row's, if others have the same page and digest or may have."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest[:16]}{'' if number is None else f':{number}'}>"


def page_of(record: str) -> int | None:
    found = record.strip("<>").split(":")[2]
    return None if found == "null" else int(found)


def _quoted(url: str) -> str:
    return quote(url, safe="/:?#[]@!$&'()*+,;=%~-._")


def _record(kind: str, identity: str, date: str, content: str, block: bytes, *more: tuple[str, str]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", identity), ("WARC-Date", date), *more, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, number: int | None, refers_to: int | None, refers_url: str | None, revisit: bool, date: str) -> bytes:
    """A response, or the revisit of the page whose id and address it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = [("WARC-Target-URI", _quoted(url))] if url else []
    more.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, None)), ("WARC-Refers-To-Date", date), *([("WARC-Refers-To-Target-URI", _quoted(refers_url))] if refers_url else [])]
    return _record("revisit" if revisit else "response", record_id(page_id, digest, number), date, "application/http; msgtype=response", http if revisit else http + payload, *more)


def info(name: str, date: str) -> bytes:
    """The record that says what an archive is."""
    block = b"software: evidenceloom\r\nformat: WARC File Format 1.1\r\n"
    return _record("warcinfo", f"<urn:archive:{name}>", date, "application/warc-fields", block, ("WARC-Filename", f"{name}.warc.zst"))


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' plain content."""
    parts = [s[i : i + 2048] for s in samples for i in range(0, len(s), 2048)]
    total = sum(map(len, parts))
    if len(parts) >= 32:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, total // 8), parts).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY]


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", smallest: int = SMALLEST, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives below path; path and n_records of each."""
    rows = pick(pages, page_id=page_id, url=url, payload=payload).withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "number": F.monotonically_increasing_id()})
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "number", "url")))
    groups = rows.where(F.octet_length("payload") >= smallest).groupBy(F.col("digest").alias("d")).agg(least.alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    marked = rows.join(groups, F.col("digest") == F.col("d"), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first.page_id"))), F.lit(False))
    number = F.when(F.col("first").isNull() | (F.col("number") != F.col("first.number")), F.col("number"))
    marked = marked.select("page_id", "url", "payload", "digest", number.alias("number"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_url"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record(*row, date) for batch in batches for i in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True))
        sample, size = [], 0
        for r in records:
            sample.append(r)
            size += len(r)
            if size >= SAMPLE:
                break
        if not sample:
            return
        own, n = uuid.uuid4().hex, 0
        name = f"{path}/{own}.warc.zst"
        words = dictionary(sample)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words))
        frame = zstandard.ZstdCompressor(level=19).compress(words)
        with AtomicFile(name) as out:
            out.write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
            out.write(packer.compress(info(own, date)))
            for r in chain(sample, records):
                out.write(packer.compress(r))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return written(marked.mapInArrow(run, "path string, n_records long"), "archives")


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of an archive."""
    system, path = opened(path)
    with system.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} doesn't begin with a dictionary")
        words = zstandard.ZstdDecompressor().decompress(f.read(size))
        stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).stream_reader(f, read_across_frames=True), 1 << 18)
        while line := stream.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: no record where one should begin")
            head = {}
            while (line := stream.readline()) != b"\r\n":
                key, _, value = line.decode().partition(":")
                head[key.lower()] = value.strip()
            block = stream.read(int(head["content-length"]))
            stream.read(4)
            yield head, block


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, payloads held against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for head, block in records(path):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
                    digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
                    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: {head['warc-record-id']} is damaged")
                    rows.append((page_of(head["warc-record-id"]), length, digest, kind, page_of(head["warc-refers-to"]) if kind == "revisit" else None))
                    if len(rows) == 5000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(parts, "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame, **more) -> DataFrame:
    """Writes pages into the shared folder and reads the archives back."""
    spark: SparkSession = pages.sparkSession
    return read(write(pages, scratch(spark, "warc"), **more))


#: The same over the table pages, for DuckDB.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
d AS (SELECT page_id, n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL OR page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)
"""
