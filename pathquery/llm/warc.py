"""WARC archives compressed with a Zstandard dictionary of their own.

Every archive starts with a skippable frame that holds its dictionary (built from a sample of its own first records);
each record is a frame of its own, so that any record can be read alone.  Spark's text sink writes the archives: a row is
a frame and the line separator is an empty skippable frame, so files are whole .warc.zst streams, are committed by
Spark's protocol (a lost task leaves nothing behind) and may go to any store that Spark can write.

Of records with equal payloads of at least `least` bytes, that with the smallest id is a response and the others are
revisits that carry no payload.  Defined results: null payload counts as empty; rows that repeat the smallest id of
their group are responses each; a group whose ids are all null has responses only; an empty table gives no archive and
an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_count, map_slices

#: Fixed values of the frame formats: magic of zstd frames, and of skippable frames (the one of dictionaries, the empty separator).
FRAME = 0xFD2FB528
DICTIONARY = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: Bytes of records that a dictionary is built from, and its own size at most.
SAMPLE_BYTES, DICT_BYTES = 1_000_000, 32_768
#: Bytes of input to an archive, about.
ARCHIVE_BYTES = 8 << 20
CRLF = "\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or, of too few records, their raw content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICT_BYTES:]


def loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
    """Trained or raw, as its first bytes say."""
    return zstandard.ZstdCompressionDict(raw)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    head = [("WARC-Type", "response" if refers_to is None else "revisit")]
    if page_id is not None:
        head += [("WARC-Record-ID", f"<urn:page:{page_id}>")]
    if url:
        head += [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    block = http + (payload if refers_to is None else b"")
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return f"WARC/1.1{CRLF}{''.join(f'{k}: {v}{CRLF}' for k, v in head)}{CRLF}".encode() + block + b"\r\n\r\n"


def frames(data: bytes):
    """(magic, start, end) of each frame, found by walking block headers; nothing is decompressed."""
    at = 0
    while at < len(data):
        magic, start = struct.unpack_from("<I", data, at)[0], at
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME:
            d = data[at + 4]
            single, checksum, size_flag = d >> 5 & 1, d >> 2 & 1, d >> 6
            at += 5 + (not single) + (0, 1, 2, 4)[d & 3] + ((1 if single else 0), 2, 4, 8)[size_flag]
            last = 0
            while not last:
                head = int.from_bytes(data[at : at + 3], "little")
                last, kind, n = head & 1, head >> 1 & 3, head >> 3
                at += 3 + (1 if kind == 1 else n)
            at += 4 * checksum
        else:
            raise ValueError(f"no frame at byte {at}")
        yield magic, start, at


def parsed(raw: bytes) -> dict:
    """A record's fields; a response's payload is hashed again, and must agree with its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split(CRLF)[1:])["Content-Length"])
    number = lambda k: int(fields[k].rpartition(":")[2][:-1]) if k in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload}


def compressed(batches):
    """Rows of records to frames: the dictionary's skippable frame leads."""
    coder, held, size = None, [], 0

    def out(raws):
        return pa.RecordBatch.from_arrays([pa.array([coder.compress(r) for r in raws], pa.binary())], ["frame"])

    def begin():
        nonlocal coder, size
        raw = dictionary(held)
        coder = zstandard.ZstdCompressor(level=6, dict_data=loaded(raw), write_checksum=False)
        size = None
        return pa.RecordBatch.from_arrays([pa.array([struct.pack("<II", DICTIONARY, len(raw)) + raw], pa.binary())], ["frame"])

    for b in batches:
        raws = [record(*x) for x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")))]
        if coder is None:
            held += raws
            size += sum(map(len, raws))
            if size < SAMPLE_BYTES:
                continue
            raws = held
            yield begin()
        for i in range(0, len(raws), 256):
            yield out(raws[i : i + 256])
        held = []
    if held:
        yield begin()
        for i in range(0, len(held), 256):
            yield out(held[i : i + 256])


def typed(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: a response) of every row.

    Groups of equal payloads are found on digests alone; then only (id, digest, refers_to) of revisits meets the rows,
    by id and digest, so that a payload that a third of all rows share is spread like any other.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    slim = rows.filter(F.length("payload") >= least).groupBy("digest", "page_id").count()
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = slim.join(firsts, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to")
    rows = rows.repartition(block_count(pages, ARCHIVE_BYTES), "page_id", "digest")
    return rows.join(revisits.hint("shuffle_hash"), ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Writes pages as archives under `path`, one for each partition."""
    frames_ = typed(pages, **columns).mapInArrow(compressed, "frame binary")
    frames_.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under `path`, each decompressed with its archive's dictionary; revisits have no payload."""
    schema = RECORD if payloads else RECORD.removesuffix(", payload binary")
    names = [x.split()[0] for x in schema.split(", ")]

    def make():
        def run(part: pa.RecordBatch) -> dict:
            out = {c: [] for c in names}
            for data in part.column(0).to_pylist():
                coder = None
                for magic, start, end in frames(data):
                    if magic == DICTIONARY:
                        coder = zstandard.ZstdDecompressor(dict_data=loaded(data[start + 8 : end]))
                    elif magic == FRAME:
                        got = parsed(coder.decompress(data[start:end]))
                        for c in names:
                            out[c].append(got[c])
            return out

        return run

    files = spark.read.format("binaryFile").load(path)
    return map_slices(files, ["content"], "content", schema, make, 1)
