"""WARC archives, each record a Zstandard frame under the archive's own dictionary.

Each task writes one archive: it builds a dictionary from a bounded sample of
the records it archives, puts it into a skippable frame at the head, then
compresses every record on its own. Files go through Spark's writer, so they
land in any store with its commit protocol; the line separator it insists on is
itself an empty skippable frame, which every Zstandard reader passes over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefolio.session import cut_lineage, new_table_path

#: fixed values of the formats: frame that holds a dictionary, empty frame of no meaning, its tag, a plain frame
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
FILLER = b"P*M\x18\x00\x00\x00\x00"
SKIPPABLE = b"\x2a\x4d\x18"
FRAME = b"\x28\xb5\x2f\xfd"
LEVEL = 6
DICTIONARY = 1 << 16  # bytes, at most
SAMPLE = 4 << 20  # bytes of records that a dictionary is built from, at most
SAMPLE_RECORD = 1 << 15  # of which from one record
DATE = "1970-01-01T00:00:00Z"  # archives are rebuilt byte for byte when a task is run again
PAGE_URN = "urn:page:"
OUT = 1 << 22
STEP = 1 << 13


def _safe(url: str) -> str:
    """A url that fits a header line: other bytes than printable ASCII are percent-encoded."""
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit with the same headers and none."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_safe(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        *([f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record; of a revisit, payload is None and payload_bytes what its HTTP header says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    urn = lambda name: field[name][1 + len(PAGE_URN) : -1] if name in field else ""
    revisit = field["WARC-Type"] == "revisit"
    return {
        "page_id": int(urn("WARC-Record-ID")) if urn("WARC-Record-ID") else None,
        "url": unquote(field["WARC-Target-URI"]) if "WARC-Target-URI" in field else None,
        "record_type": field["WARC-Type"],
        "payload_bytes": length,
        "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": int(urn("WARC-Refers-To")) if urn("WARC-Refers-To") else None,
        "payload": None if revisit else payload,
    }


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or of too few records their own bytes; empty of none."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def archive(records: Iterator[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """Frames of an archive: the dictionary's, then one per record. Records beyond the sample are not held back."""
    held, samples, total = [], [], 0
    compressor = None

    def opened():
        nonlocal compressor
        raw = build_dictionary(samples)
        if raw:
            packed = zstandard.ZstdCompressor(level=19).compress(raw)
            yield DICTIONARY_FRAME + struct.pack("<I", len(packed)) + packed
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
        for r in held:
            yield compressor.compress(r)
        held.clear()

    for record in records:
        if compressor:
            yield compressor.compress(record)
            continue
        held.append(record)
        samples.append(record[:SAMPLE_RECORD])
        total += len(record)
        if total >= SAMPLE:
            yield from opened()
    if held:
        yield from opened()


def read_archive(data: bytes) -> Iterator[bytes]:
    """Records of an archive."""
    decompressor, at = zstandard.ZstdDecompressor(), 0
    view = memoryview(data)
    while at < len(data):
        if data[at + 1 : at + 4] == SKIPPABLE and data[at] & 0xF0 == 0x50:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at : at + 4] == DICTIONARY_FRAME:
                raw = zstandard.ZstdDecompressor().decompress(bytes(view[at + 8 : at + 8 + size]))
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        elif data[at : at + 4] == FRAME:
            frame, parts = decompressor.decompressobj(), []
            while not frame.eof:  # fed in small steps, so that what follows the frame is not copied each time
                if at >= len(data):
                    raise ValueError("the last frame is cut off")
                parts.append(frame.decompress(view[at : at + STEP]))
                at = min(at + STEP, len(data))
            at -= len(frame.unused_data)
            yield b"".join(parts)
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write page_id, url and html as archives under the path.

    Of records with equal payloads (the html in UTF-8, null as empty) of at
    least `least` bytes, the one with the smallest page_id is a response, the
    others revisits that refer to it; smaller payloads are all responses. Rows
    repeated with that smallest page_id are responses too. Rows without
    page_id refer to the smallest id of their payload; if no row has one, all
    are responses. Null urls have no target header; other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    large = rows.where(F.octet_length("payload") >= least)
    first = cut_lineage(
        large.groupBy("same").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "refers_to")
    )
    joined = rows.join(first, "same", "left").select(
        "page_id",
        "url",
        "payload",
        F.when((F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")).alias("refers_to"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for page_id, url, payload, refers in zip(*batch.columns, strict=True):
                    body, to = payload.as_py(), refers.as_py()
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    yield record_bytes(page_id.as_py(), url.as_py(), body, digest, to, to is not None)

        held, size = [], 0
        for frame in archive(records()):
            held.append(frame)
            size += len(frame)
            if size >= OUT:
                yield pa.record_batch([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(held, pa.binary())], ["frame"])

    frames = joined.mapInArrow(work, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", FILLER.decode("latin-1")).text(path)


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under the path."""

    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[f.split(" ")[1]] for f in RECORD.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in read_archive(content.as_py()):
                    held.append(parse_record(record))
                    size += len(record)
                    if size >= OUT:
                        yield pa.record_batch([pa.array([h[n] for h in held], k) for n, k in zip(names, kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array([h[n] for h in held], k) for n, k in zip(names, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(work, RECORD)


def archive_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to new archives in the shared folder and read them back."""
    path = new_table_path(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
