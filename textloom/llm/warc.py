"""Sharded WARC archives that are the same bytes at every run.

Records are range-sorted by (url, page_id, payload digest). Where shards begin follows
from the data alone: keys and payload sizes are sorted first, and a running sum of the
sizes over the whole order is cut at multiples of the shard's bytes, so neither the
cluster nor a sample of Spark's has a say. A shard is written by one task in the order
of the keys and rolls to its next file when the compressed size reaches the limit.
Headers are made anew: ids and digests come from the contents and the date is a
parameter. Files are written under temporary names and renamed when whole; the
manifest, itself a table written at the end, lists the files that count with their
sizes and SHA-256, and readers take no other file.

Of records with equal payloads of at least ``revisit_bytes`` the one with the
largest page_id is a response, and the others are revisits that refer to it.

Defined results: a null html is an empty payload; a null url is left out of the
headers; a null page_id sorts below all others and its record carries none; rows
that repeat the largest page_id with the same payload are responses all; an empty
table gives an archive without files. Columns other than these are not archived.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.files import committed, filesystem
from textloom.skew import join_counted
from textloom.storage import maybe_broadcast, materialize, new_path, read_table

REVISIT_BYTES = 1000
#: A file is closed at this compressed size; a single larger record still goes into one file.
ROLL_BYTES = 32 << 20
#: Raw payload bytes of a shard, at least, and shards, at most; their first keys are broadcast.
SHARD_BYTES, SHARDS = 32 << 20, 50_000
#: Revisits are broadcast when they are counted to be at most so many.
BROADCAST_ROWS = 200_000
#: Payload bytes that a reading task sends on at a time, and reading tasks, at most.
READ_BYTES, READ_TASKS = 1 << 22, 20_000
DATE = "2024-01-01T00:00:00Z"
_MANIFEST = "file string, records long, bytes long, sha256 string"
_ID = "X-Page-Id"
_ORDER = ["url", "page_id", "digest"]


@dataclass(frozen=True)
class Archive:
    path: str
    manifest: DataFrame


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (bytes) and its SHA-1 of every row."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))


def revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest, refers_to of the records that are revisits; only digests move."""
    known = materialize(payloads(pages).where(F.octet_length("payload") >= revisit_bytes).select("page_id", "digest"), "payload-digests")
    groups = known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = join_counted(known, groups, "digest", "copies", known.count())
    return materialize(found.where("refers_to is not null and not page_id <=> refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")


def _name(digest: bytes, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'%s %r' % (digest, page_id)).digest()[:16])}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One gzip member with one response or revisit record."""
    is_revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if is_revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_name(digest, page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        # A line break in a url would end the header.
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest.hex()}")
    if page_id is not None:
        lines.append(f"{_ID}: {page_id}")
    if is_revisit:
        lines += [f"WARC-Refers-To: {_name(digest, refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["WARC-Block-Digest: sha1:" + hashlib.sha1(body).hexdigest(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def _key(url: str | None, page_id: int | None, digest: bytes) -> tuple:
    """Sorts as Spark does: nulls first, strings by code points."""
    return url is not None, url or "", page_id is not None, page_id or 0, digest


def first_keys(pages: DataFrame, shard_bytes: int = SHARD_BYTES, shards: int = SHARDS) -> list[tuple]:
    """The first key of each shard but the first one; only keys and sizes are sorted."""
    rows = payloads(pages).select(*_ORDER, F.octet_length("payload").cast("long").alias("size"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.asarray(batch["size"])
            start = before + np.cumsum(size) - size
            before += int(size.sum())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in _ORDER), pa.array(size), pa.array(start), pa.array(np.full(len(size), part))], [*_ORDER, "size", "start", "part"])

    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(tasks, *_ORDER).sortWithinPartitions(*_ORDER)
    placed = materialize(ranged.mapInArrow(sums, "url string, page_id long, digest binary, size long, start long, part long"), "record-places")
    # One row for each task of the sort.
    totals = sorted(map(tuple, placed.groupBy("part").agg(F.sum("size")).collect()))
    total = sum(n for _, n in totals)
    step, before, offsets = max(shard_bytes, -(-total // shards)), 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    known = placed.join(F.broadcast(pages.sparkSession.createDataFrame(offsets, "part long, before long")), "part")
    shard = F.floor((F.col("before") + F.col("start")) / step).alias("shard")
    # At most ``shards`` + 1 rows.
    found = known.select(*_ORDER, shard).where("shard > 0").groupBy("shard").agg(F.min(F.struct(*_ORDER)).alias("first")).orderBy("shard").collect()
    return [_key(r.first.url, r.first.page_id, bytes(r.first.digest)) for r in found]


def write(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES, shard_bytes: int = SHARD_BYTES) -> Archive:
    """Writes the archive into ``path`` and returns it with its manifest."""
    spark = pages.sparkSession
    found = maybe_broadcast(revisits(pages, revisit_bytes), BROADCAST_ROWS).withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    rows = payloads(pages)
    rows = rows.join(found, rows["page_id"].eqNullSafe(found["_id"]) & (rows["digest"] == found["_digest"]), "left").drop("_id", "_digest")
    firsts = first_keys(pages, shard_bytes)
    sent = spark.sparkContext.broadcast(firsts)

    @F.pandas_udf("long")
    def shard_of(url: pd.Series, has_id: pd.Series, page_id: pd.Series, digest: pd.Series) -> pd.Series:
        keys = (_key(u, int(p) if has else None, bytes(d)) for u, has, p, d in zip(url, has_id, page_id, digest, strict=True))
        return pd.Series([bisect_right(sent.value, k) for k in keys], dtype="int64")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for batch in batches for r in zip(batch["shard"].to_pylist(), *(batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True))
        row, last, part, files = next(records, None), None, 0, []
        while row is not None:
            shard = row[0]
            part = part + 1 if shard == last else 0
            last = shard
            name, n, size, check = f"{shard:06d}-{part:06d}.warc.gz", 0, 0, hashlib.sha256()
            with committed(f"{path}/{name}") as out:
                while row is not None and row[0] == shard and (not n or size < roll_bytes):
                    raw = record(*(x.as_py() for x in row[1:]))
                    out.write(raw)
                    check.update(raw)
                    n, size = n + 1, size + len(raw)
                    row = next(records, None)
            files.append((name, n, size, check.hexdigest()))
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], ["file", "records", "bytes", "sha256"])

    if firsts:
        ranged = rows.withColumn("shard", shard_of("url", F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), "digest"))
    else:
        ranged = rows.withColumn("shard", F.lit(0).cast("long"))
    # A partition for each shard, which hashing would not give.
    ranged = ranged.repartitionById(len(firsts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", *_ORDER)
    ranged.mapInArrow(task, _MANIFEST).write.parquet(f"{path}/_manifest")
    return open_archive(spark, path)


def open_archive(spark: SparkSession, path: str) -> Archive:
    """An archive that was written before."""
    return Archive(path, spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest"))


def _records(source: BinaryIO, check) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file of gzip members, read in pieces; ``check`` gets all bytes."""
    piece = b""
    while piece or (piece := source.read(1 << 16)):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not piece and not (piece := source.read(1 << 16)):
                raise ValueError("a file ends within a record")
            parts.append(inflate.decompress(piece))
            used = len(piece) - len(inflate.unused_data)
            check.update(memoryview(piece)[:used])
            piece = piece[used:]
        member = b"".join(parts)
        head, _, rest = member.partition(b"\r\n\r\n")
        lines = io.StringIO(head.decode(), newline="\r\n")
        next(lines)
        headers = dict(x.rstrip("\r\n").split(": ", 1) for x in lines)
        yield headers, rest[: int(headers["Content-Length"])]


def read(archive: Archive) -> DataFrame:
    """One row per record of the files that the manifest lists; digests are checked on the way.

    Tasks get names of files, never contents. A revisit's payload size is the one that
    its HTTP header states.
    """
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    path = archive.path

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, sha256 in (x for b in batches for x in zip(b["file"].to_pylist(), b["sha256"].to_pylist(), strict=True)):
            rows, held, check = [], 0, hashlib.sha256()
            system, name = filesystem(f"{path}/{file}")
            with system.open_input_stream(name, compression=None) as source:
                for headers, block in _records(source, check):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload differs from its digest")
                    ids = [int(headers[k]) if k in headers else None for k in (_ID, "X-Refers-To-Page-Id")]
                    rows.append((ids[0], headers.get("WARC-Target-URI"), payload, size, digest, headers["WARC-Type"], ids[1]))
                    held += len(payload)
                    if held > READ_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            if check.hexdigest() != sha256:
                raise ValueError(f"{file} differs from the manifest")
            if rows:
                yield _batch(rows)

    files = archive.manifest.select("file", "sha256")
    return files.repartition(max(1, min(files.count(), READ_TASKS)), "file").mapInArrow(task, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write(read_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
