"""WARC archives with an index first.

Writing gives one gzip member per record (so each can be read alone) and an
index row with its file, offset, length, URL and payload digest. Reading starts
from index rows: those selected are sorted by place, neighbouring byte ranges
are coalesced into one read, and records are parsed out of it.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the
largest id is stored as response; the others are revisit records without payload.

Edge cases: a null payload is empty; a null URL leaves out WARC-Target-URI; a
null id never is a keeper; rows that repeat the keeper's id are responses too, which
is all there is of ties; a very long payload is one record, compressed and read whole;
an empty table gives an empty index; further columns are ignored.

A task names its files after its attempt, and only files of attempts that
succeed are in the index, so a lost executor leaves at most unread files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, erase, join_counted, new_path, small_batches, written
from .storage import RangeReader, create
from .textkit import lean, utf8

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
#: Gap that a read may bridge, and most bytes of one read.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
RECORD_ID = "urn:page:"
INDEX_SCHEMA = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, keeper) of the records that repeat another's payload.

    Works on ids and digests only, which are written, as are the groups, counted with
    map-side combine: so the join's sides are plain, and a payload of a third of all pages is
    sent to or split over many tasks.
    """
    narrow = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).filter(F.col("n") >= REVISIT_BYTES)
    narrow = written(narrow, "payloads")
    groups = narrow.groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and keeper is not null")
    groups = written(groups, "payload-groups")
    found = written(join_counted(narrow, groups, ["digest", "n"]).filter("not page_id <=> keeper").select("page_id", "digest", "keeper").distinct(), "revisits")
    erase(narrow, groups)
    return found


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str) -> tuple[bytes, str]:
    """The gzip member of one record, and its payload digest."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if keeper is not None else http + payload
    fields = [("WARC-Type", "response" if keeper is None else "revisit"), ("WARC-Record-ID", f"<{RECORD_ID}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if keeper is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{RECORD_ID}{keeper}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(_header(fields) + block + b"\r\n\r\n") + pack.flush(), digest


def parse(member: bytes) -> dict:
    """Fields of a record from its gzip member; the payload is checked against the headers."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length"))
    ident = lambda x: int(x[1:-1].removeprefix(RECORD_ID)) if x and x[1:-1] != RECORD_ID else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": ident(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": digest,
        "record_type": kind, "refers_to": ident(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def write(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) into ``folder``; returns the index, itself a table there."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    again = revisits(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    again = again.select(F.col("page_id").cast("long").alias("again_id"), F.col("digest").alias("again_digest"), F.col("keeper").cast("long").alias("keeper"))
    few = again.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(again) if few else again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select("page_id", "url", "html", "keeper")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, uri, at, number = None, "", 0, 0
        info = zlib.compressobj(6, zlib.DEFLATED, 31)
        about = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
        opening = info.compress(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:archive>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(about)))]) + about + b"\r\n\r\n") + info.flush()
        try:
            for batch in batches:
                index = []
                for page_id, url, payload, keeper in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        uri = f"{folder}/archive/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:03d}.warc.gz"
                        out, number = create(uri), number + 1
                        out.write(opening)
                        at = len(opening)
                    member, digest = record(page_id, url, payload, keeper, date)
                    out.write(member)
                    index.append((uri, at, len(member), url, digest, page_id, "response" if keeper is None else "revisit", keeper))
                    at += len(member)
                if index:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        finally:
            if out is not None:
                out.close()

    small_batches(spark)
    joined.mapInArrow(lean(store), INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows, by coalesced byte-range reads in order of place."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = RangeReader(), []

        def flush() -> pa.RecordBatch:
            uri, begin = held[0][0], held[0][1]
            raw = reader.read(uri, begin, max(o + n for _, o, n in held) - begin)
            found = [parse(raw[o - begin : o - begin + n]) for _, o, n in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in zip(names, types, strict=False)], names=names)

        try:
            for batch in batches:
                for uri, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if held and (uri != held[0][0] or offset - (held[-1][1] + held[-1][2]) > GAP_BYTES or offset + length - held[0][1] > READ_BYTES):
                        yield flush()
                    held.append((uri, offset, length))
            if held:
                yield flush()
        finally:
            reader.close()

    small_batches(index.sparkSession)
    stretch = F.floor(F.col("offset") / FILE_BYTES)
    return index.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions("file", "offset").mapInArrow(lean(fetch), schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read every record back."""
    return read(write(pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
