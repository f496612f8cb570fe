"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive holds up to `ARCHIVE_BYTES` of records. A dictionary is trained on its records (evenly spread ones, up to `SAMPLE_BYTES`), written first
in a skippable frame, itself compressed, and every record is a frame of its own, so that a reader can start at any
record. Of records with equal payloads of at least `min_revisit` bytes the one with the largest id is a
response and the others are revisits of it, without a body.

Defined results: a null payload is empty; a null url is an empty target; pages of one id stay separate records. An archive whose
records are too few or small to train on has no dictionary and no skippable frame. Rows with a null id cannot
be referred to and are responses unless another equal payload has an id.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, tidy

ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 48 << 10
#: The frame magic that a reader skips, as WARC archives use it for dictionaries (fixed value).
SKIPPABLE = 0x184D2A5D
LEVEL = 3


def record(page_id: int | None, url: str, kind: str, digest: str, size: int, refers_to: int | None, body: bytes) -> bytes:
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else str(page_id).encode()),
        b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"X-Payload-Length: %d" % size,
    ]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.decode().split(": ", 1) if ": " in x.decode() else (x.decode().rstrip(":"), "") for x in head.split(b"\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields, body


def pack(records: list[bytes]) -> bytes:
    """One archive."""
    # Records that are few or large give at least 16 samples too, then the beginnings of them.
    step = max(1, min(-(-sum(map(len, records)) // SAMPLE_BYTES), len(records) // 16))
    samples = [x[: max(1, SAMPLE_BYTES * step // len(records))] for x in records[::step]]
    head, options = b"", {}
    if len(samples) >= 16:
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8, level=LEVEL)
        except zstandard.ZstdError:
            trained = None
        if trained is not None:
            data = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
            head, options = struct.pack("<II", SKIPPABLE, len(data)) + data, {"dict_data": trained}
    one = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options)
    return head + b"".join(one.compress(x) for x in records)


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, by its own bytes alone."""
    at, options = 0, {}
    if len(archive) >= 8:
        magic, size = struct.unpack_from("<II", archive)
        if magic == SKIPPABLE:
            options["dict_data"] = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size]))
            at = 8 + size
    reader = zstandard.ZstdDecompressor(**options)
    view = memoryview(archive)
    while at < len(archive):
        one = reader.decompressobj()
        out = [one.decompress(view[at : (stop := min(len(archive), at + (1 << 16)))])]
        while not one.eof:
            if stop >= len(archive):
                raise ValueError("an archive ends within a record")
            out.append(one.decompress(view[stop : (stop := min(len(archive), stop + (1 << 16)))]))
        at = stop - len(one.unused_data)
        yield b"".join(out)


def write(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Archives (archive string, records long, content binary) of rows (page_id, url, html)."""
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    src = src.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    # Counts go to the shuffle before pages do; only payloads that repeat are looked up again.
    response = src.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A row for each payload that repeats. Few are broadcast, and no page is shuffled.
    told = src.join(counted(cut(response.select("digest", "response")), 200_000), "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        kept: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            nonlocal kept, size, count
            name = f"part-{part:06d}-{count:06d}.warc.zst"
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(kept)], pa.int64()), pa.array([pack(kept)], pa.binary())], ["archive", "records", "content"])
            kept, size, count = [], 0, count + 1
            return out

        for batch in batches:
            for digest, page, url, html, n, response in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                again = response is not None and page != response
                kept.append(record(page, url or "", "revisit" if again else "response", digest, n, response if again else None, b"" if again else html.encode()))
                size += len(kept[-1])
                if size >= ARCHIVE_BYTES:
                    yield done()
        if kept:
            yield done()

    return told.select("digest", "page_id", "url", "html", "bytes", "response").mapInArrow(tidy(run), "archive string, records long, content binary")


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (content binary): headers, and the payload's own length and digest where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for raw in unpack(content):
                    head, body = parse(raw)
                    kind = head["WARC-Type"]
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].partition(":")[2]
                    if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                    page, refers = (head.get(k, "")[len("<urn:page:") : -1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    rows.append((int(page) if page else None, head["WARC-Target-URI"], size, digest, kind, int(refers) if refers else None))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("content").mapInArrow(tidy(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Write the archives into the shared folder and read them back."""
    return read(cut(write(pages, min_revisit)))
