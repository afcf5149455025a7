"""WARC archives: a writer of one gzip member per record, and a splittable reader.

A reading task owns the records whose gzip member starts inside its byte range. It scans the range for the gzip magic,
accepts a candidate only when its first bytes decode to a WARC header, and from there walks from member to member; the
last one may end beyond the range. So archives of any size are read in parallel without an index.

Archives lie in a folder that driver and executors share, and are reached through ``stores``. Writing tasks name
their file by attempt, and only files of attempts that succeeded are listed, so a lost executor leaves no doubles.

Defined cases: a null payload is an empty one; null or repeated ids give records with that id; a null URL leaves the
target out; line ends in a URL are percent-encoded; an empty table gives archives without records; extra columns are
not stored. Of records with equal payloads of ``least`` bytes or more, all that carry the smallest id are responses
(one, if ids are unique) and the others are revisits that refer to it.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.sources.stores import open_store, store_settings

#: Payloads below this many bytes are always stored.
LEAST = 100
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 18
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT_TYPE = "application/http; msgtype=response"
RECORD = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"


class Archive(NamedTuple):
    path: str
    size: int
    records: int


class CorruptArchive(Exception):
    """A record's payload doesn't have the digest that its header states."""


def mark_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST) -> DataFrame:
    """``pages`` with ``payload`` (binary), ``digest``, ``first`` (the response's key, for revisits).

    Only digests that occur more than once are joined back, and adaptive execution splits a hot one.
    """
    p = pages.withColumn("payload", F.coalesce(F.col(payload), F.lit("")).cast("binary")).withColumn("digest", F.sha2("payload", 256))
    alike = p.where(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("_digest"))
    first = alike.agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = p.join(first, F.col("digest") == F.col("_digest"), "left")
    return joined.withColumn("first", F.when(~F.col(key).eqNullSafe(F.col("_first")), F.col("_first"))).drop("_digest", "_first", "_n")


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the response's HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"Content-Type: {CONTENT_TYPE}", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return gzip.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n", 6, mtime=0)


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z"
) -> list[Archive]:
    """Write every row as a record, and list the archives: one for each task, in the shared ``folder``."""

    settings = store_settings(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = open_store(folder, settings)
        system.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        size = records = 0
        with system.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as out:
            for batch in batches:
                for i, u, data, digest, first in zip(*(batch.column(k) for k in range(5)), strict=True):
                    ref = first.as_py()
                    member = record_bytes(f"urn:page:{i.as_py()}", u.as_py(), data.as_py(), digest.as_py(), None if ref is None else f"urn:page:{ref}", date)
                    out.write(member)
                    size, records = size + len(member), records + 1
        yield pa.RecordBatch.from_pydict({"path": [name], "size": [size], "records": [records]})

    marked = mark_revisits(pages.select(key, url, payload), key, payload, least)
    rows = marked.select(key, url, "payload", "digest", "first").mapInArrow(run, "path string, size long, records long").collect()
    return [Archive(f"{folder}/{r.path}", r.size, r.records) for r in rows]


class _Source:
    """Bytes of a file from any offset, read forward in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.buffer = file, size, 0, b""

    def read(self, at: int) -> bytes:
        """Some bytes from offset ``at``; empty at the end of the file."""
        if not self.at <= at < self.at + len(self.buffer):
            self.file.seek(at)
            self.at, self.buffer = at, self.file.read(READ_BYTES)
        return self.buffer[at - self.at :]


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at an offset and the offset after it, or None if there is no such member."""
    inflate, out, pos = zlib.decompressobj(31), [], at
    size = 0
    try:
        while not inflate.eof:
            data = source.read(pos)
            if not data:
                return None
            out.append(inflate.decompress(data))
            size += len(out[-1])
            pos += len(data)
            if len(VERSION) <= size and len(out) <= 2 and not b"".join(out[:2]).startswith(VERSION):
                return None
    except zlib.error:
        return None
    record = b"".join(out)
    return (record, pos - len(inflate.unused_data)) if record.startswith(VERSION) else None


def members(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Records whose gzip member starts in [start, end)."""
    source, at = _Source(file, size), start
    while at < min(end, size):
        data = source.read(at)
        if len(data) < len(MAGIC) and at + len(data) < size:  # the magic may straddle two pieces
            source.buffer = b""
            data = source.read(at)
        found = data.find(MAGIC)
        if found < 0:
            if at + len(data) >= size:
                return
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        member = _member(source, at)
        if member is None:
            at += 1
        else:
            record, at = member
            yield record


def parse_record(record: bytes) -> tuple:
    """Fields of ``RECORD``; a response's digest is taken from its payload and held against its header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields["warc-type"]
    if kind == "response":
        size = len(payload)
        if (own := hashlib.sha256(payload).hexdigest()) != digest:
            raise CorruptArchive(f"{fields['warc-record-id']}: payload digest {own}, stated {digest}")
    else:
        lengths = [int(line.split(b":", 1)[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size, payload = (lengths or [None])[0], None
    bare = lambda x: x and x.strip("<>")
    return bare(fields["warc-record-id"]), kind, fields.get("warc-target-uri"), fields.get("warc-date"), digest, size, bare(fields.get("warc-refers-to")), payload


def read_archives(spark: SparkSession, archives: list[Archive], split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """One row (``RECORD``) per record of the archives; ``payloads=False`` leaves the payloads out."""

    settings = store_settings(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for path, size, start, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                system, name = open_store(path, settings)
                rows, held = [], 0
                with system.open_input_file(name) as file:
                    for record in members(file, size, start, end):
                        fields = parse_record(record)
                        rows.append(fields if payloads else (*fields[:-1], None))
                        held += len(record) if payloads else 0
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    # the driver names the archives; their splits are made in the plan
    listed = spark.createDataFrame([(a.path, a.size) for a in archives], "path string, size long").where("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    splits = listed.select("path", "size", starts).withColumn("end", F.least(F.col("start") + split_bytes, F.col("size")))
    tasks = max(1, sum(-(-a.size // split_bytes) for a in archives))
    return splits.repartition(tasks).mapInArrow(run, RECORD)
