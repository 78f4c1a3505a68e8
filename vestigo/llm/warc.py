"""WARC archives in Zstandard with a dictionary built from the records.

An archive file starts with a skippable frame that holds the dictionary; every record is a frame of
its own, so a reader can start at any of them. Spark's own text sink writes the frames, so archives can
stand on any store Spark writes to: a row is one frame, and the separator that the sink puts after
each row is an empty skippable frame, which every Zstandard reader passes over.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vestigo.session import checkpoint_dir

#: Little-endian magic numbers: frame with a dictionary, frame of no content (ASCII, so the sink takes it as text).
DICTIONARY_FRAME = (0x184D2A5D).to_bytes(4, "little")
SEPARATOR = "P*M\x18\0\0\0\0"
#: Bounds of the dictionary and of the sample that it is built from (by hash of page_id).
DICTIONARY_BYTES = 112_640
SAMPLED_RECORDS = 2_000
SAMPLED_RECORD_BYTES = 16_384
#: Frames of one archive file, its dictionary included.
FRAMES_PER_FILE = 512
#: WARC-Date of records whose time of capture is not known.
UNDATED = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the digest and length of the payload but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", UNDATED),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields[4:4] = [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to)),
            ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to)),
        ]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + _CRLF for k, v in fields) + _CRLF
    return head + block + _CRLF + _CRLF


def parsed(raw: bytes) -> dict:
    """Fields of a record read back; payload_bytes and payload_digest are taken from a response's payload
    and from a revisit's headers."""
    head, _, rest = raw.partition(_CRLF + _CRLF)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_CRLF + _CRLF)
    revisit = fields["WARC-Type"] == "revisit"
    length = next(int(x.split(b":")[1]) for x in http.split(_CRLF) if x.startswith(b"Content-Length:"))
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (payload_digest(payload) != stated or len(payload) != length):
        raise ValueError(f"record of page {fields['X-Page-ID']} is damaged")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(fields["X-Page-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": stated,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("X-Refers-To-Page-ID", "")),
    }


def frames_of(archive: bytes) -> Iterator[bytes]:
    """Records of an archive, each frame decompressed with the dictionary of the leading skippable frame."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(archive):
        magic, size = archive[at : at + 4], int.from_bytes(archive[at + 4 : at + 8], "little")
        if 0x184D2A50 <= int.from_bytes(magic, "little") <= 0x184D2A5F:
            if magic == DICTIONARY_FRAME:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        frame = reader.decompressobj()
        yield frame.decompress(archive[at:])
        at = len(archive) - len(frame.unused_data)


def build_dictionary(pages: DataFrame, page_id: str, html: str, url: str) -> bytes:
    """A dictionary from a bounded sample of the records; empty where there is nothing to learn from."""
    share = min(1.0, SAMPLED_RECORDS / max(1, pages.count()))
    luck = F.pmod(F.xxhash64(page_id), F.lit(1 << 20)) / float(1 << 20)
    start = F.substring(F.coalesce(F.col(html), F.lit("")), 1, SAMPLED_RECORD_BYTES)
    rows = pages.where(luck < share).select(page_id, url, start).limit(2 * SAMPLED_RECORDS).collect()
    samples = [record(r[0], r[1], r[2].encode(), None, False) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:  # too few or too small samples to train on: their text serves as it is
        return b"".join(samples)[:DICTIONARY_BYTES]


def _compressing(dictionary: bytes):
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True)
        lead = DICTIONARY_FRAME + len(dictionary).to_bytes(4, "little") + dictionary
        written = 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if written % FRAMES_PER_FILE == 0:
                    out.append(lead)
                    written += 1
                page, url, html, refers_to, revisit = row
                out.append(writer.compress(record(page, url, html, refers_to, revisit)))
                written += 1
            yield pa.record_batch([pa.array(out, pa.binary())], names=["frame"])

    return frames


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, page_id: str = "page_id", html: str = "html", url: str = "url") -> None:
    """Write every page as a record. Of equal payloads of at least `min_payload` bytes, the page with
    the smallest page_id (null last) is the response and the others revisit it.

    Null html is an empty payload, a null url an empty one. Rows that repeat the smallest page_id of
    their payload are responses alike. An empty table gives no archive.
    """
    dictionary = build_dictionary(pages, page_id, html, url)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), payload.alias("html")).withColumn("key", F.sha2("html", 256))
    firsts = rows.groupBy("key").agg(F.min("page").alias("first")).select(F.reverse("key").alias("k"), "first")
    joined = rows.join(firsts, F.reverse("key") == F.col("k"))
    again = ~F.col("page").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_payload)
    marked = joined.select("page", "url", "html", F.when(again, F.col("first")).alias("refers_to"), again.alias("revisit"))
    frames = marked.mapInArrow(_compressing(dictionary), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", FRAMES_PER_FILE).text(path)


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under a path: page_id, url, payload (null for revisits or if not wanted),
    payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for raw in frames_of(archive.as_py()):
                    row = parsed(raw)
                    rows.append(row if payloads else row | {"payload": None})
                yield pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, schema)


def archived(pages: DataFrame, min_payload: int = 0, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_payload, page_id, html, url)
    back = read_archives(spark, path, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
