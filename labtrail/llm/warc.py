"""Web archives (WARC 1.1) of individually compressed records with an embedded dictionary.

A Zstandard dictionary is always trained, on a bounded sample of the records that are archived. Every archive
starts with a skippable frame that holds it, so an archive can be read without any other file; then
comes a frame with a `warcinfo` record and one frame per page. An archive ends after `FRAMES` frames or about
`ARCHIVE_BYTES`, so a task writes as many archives as its pages need and a reader holds a bounded one. Of pages with equal payloads the one
with the largest id is written as a response, the others as revisits that refer to it.

Archives are written by Spark's own text writer, one row per frame, so its commit protocol holds and
any file system that Spark writes to will do. The writer ends each row with a separator; the separator
used is an empty skippable frame, which readers of the format pass over. The writer begins a new file after a
number of rows; an archive that is full earlier is filled up with empty rows.

Defined cases: a null payload is an empty one; a null address is left out; payloads of rows that
repeat an id count each as a record, and every record of the response's id is a response; a null id
counts as smaller than any other. An empty table makes archives without pages, and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labtrail.llm.common import scratch

# fixed values: magic numbers of the format and of the profile for equal payloads
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"  # magic 0x184D2A50, length 0
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records that the dictionary is built from, at most, and bytes of each.
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 1 << 16
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: Pieces that records are cut into for training; bytes that the trainer gets at least, and for a byte of the dictionary.
PIECE, LEAST_BYTES, PER_BYTE = 1 << 10, 1 << 15, 8
#: Frames of an archive, and bytes from which on it takes no further page.
FRAMES, ARCHIVE_BYTES = 10_000, 1 << 28

READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the block's HTTP head but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}"]
    head.append(f"WARC-Date: {date}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_references(pages: DataFrame, key: str, body: str) -> DataFrame:
    """Add `_refers`, the id of the response that a page's record refers to, or null."""
    digested = pages.withColumn("_sha1", F.sha1(F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")))
    slim = digested.select(F.col(key).alias("_key"), "_sha1")
    groups = slim.groupBy("_sha1").agg(F.max("_key").alias("_refers"), F.count(F.lit(1)).alias("_n"))
    groups = groups.where((F.col("_n") > 1) & F.col("_refers").isNotNull()).drop("_n")
    revisits = slim.join(groups, "_sha1").where(F.col("_key").isNull() | (F.col("_key") < F.col("_refers"))).distinct()
    revisits = revisits.withColumnRenamed("_sha1", "_same")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_sha1") == F.col("_same"))
    return digested.join(revisits, same, "left").drop("_key", "_same", "_sha1")


def dictionary(pages: DataFrame, key: str, url: str, body: str, date: str) -> bytes:
    """A Zstandard dictionary from records chosen by a hash of their id."""
    total = pages.count()
    share = min(1.0, 2 * SAMPLE_RECORDS / max(total, 1))
    taken = pages.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = taken.select(key, url, F.substring(F.col(body), 1, SAMPLE_BYTES)).limit(SAMPLE_RECORDS).collect()
    records = [record(r[0], r[1], (r[2] or "").encode(), None, date) for r in rows]
    return trained(records)


def trained(records: list[bytes]) -> bytes:
    """The dictionary of a sample: an eighth of its bytes at most, and `DICTIONARY_BYTES` at most.

    The trainer looks for what several samples share and needs some; a sample of few bytes is repeated for it.
    """
    pieces = [r[k : k + PIECE] for r in records or [record(None, None, b"", None, "")] for k in range(0, len(r), PIECE)]
    whole = sum(map(len, pieces))
    pieces *= max(1, -(-LEAST_BYTES // whole))
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // PER_BYTE)
    return zstandard.train_dictionary(size, pieces).as_bytes()


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", date: str = "2000-01-01T00:00:00Z"
) -> None:
    """Write archives of `pages` into `folder`, one or more per partition."""
    shared = dictionary(pages, key, url, body, date)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared))
        info = b"software: labtrail\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:x-info:0>\r\n"
        head += f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        first = [struct.pack("<II", DICTIONARY_MAGIC, len(shared)) + shared, packer.compress(head.encode() + info + b"\r\n\r\n")]
        done, used, size = list(first), len(first), sum(map(len, first))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for i, u, b, r in zip(part["id"], part["url"], part["body"], part["refers"], strict=True):
                    if size > ARCHIVE_BYTES:
                        done += [b""] * (FRAMES - used)
                        used = FRAMES
                    if used == FRAMES:
                        done += first
                        used, size = len(first), sum(map(len, first))
                    done.append(packer.compress(record(i, u, (b or "").encode(), r, date)))
                    used, size = used + 1, size + len(done[-1])
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["frame"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["frame"])

    plain = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.col(body).alias("body"))
    rows = with_references(plain, "id", "body").select("id", "url", "body", F.col("_refers").alias("refers"))
    framed = rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    framed.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", FRAMES).text(folder)


def split_frames(data: memoryview) -> Iterator[bytes]:
    """Contents of the frames of an archive, by the dictionary in its leading frame."""
    at, shared = 0, None
    unpack = zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        if magic in SKIPPABLE:
            if magic == DICTIONARY_MAGIC and at == 0:
                shared = zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size]))
                unpack = zstandard.ZstdDecompressor(dict_data=shared)
            at += 8 + size
            continue
        frame, out = unpack.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a frame")
            piece = data[at : at + (1 << 14)]
            out.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(out)


def parse(content: bytes) -> dict | None:
    """Fields of a record as `READ` names them; null for records that are no page."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    given = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or digest(payload) != given):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    number = lambda name: int(x) if (x := fields.get(name, "<urn:x-page:>")[12:-1]) else None
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload": payload if response else None,
        "payload_bytes": size,
        "payload_digest": given,
        "refers_to": number("WARC-Refers-To"),
    }


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all archives in `folder`; an archive, which is bounded, is read by one task."""
    schema = READ if payloads else T.StructType([f for f in READ.fields if f.name != "payload"])
    names = schema.fieldNames()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([(f.name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.typeName()]) for f in schema.fields])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for frame in split_frames(memoryview(content.as_buffer())):
                    if found := parse(frame):
                        rows.append({k: found[k] for k in names})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(records, schema)


def archived(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write `pages` to new archives in the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder, payloads)
