"""Zstandard WARC archives (``.warc.zst``): writer, and a reader that checks what it reads.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary;
then each record is one Zstandard frame, compressed with that dictionary. The reader
loads the dictionary, decodes frame by frame, and validates the version line, the
mandatory headers, ``Content-Length`` against the block, the record's trailer, and block
and payload digests. What fails becomes a row with ``error`` set; later frames of the
archive are still read.

The writer stores each payload once: of the pages with equal payloads of at least
``min_revisit`` bytes the one with the largest ``page_id`` becomes a ``response``, the
others ``revisit`` records that name it. Only digests and ids are grouped and shuffled
by digest; the reduction is map-side first, and a join by page follows, so a payload that
a third of the pages share puts no more in a task than others. Archives are written by
the tasks into a fresh folder of ``spark.checkpoint.dir``, each under a temporary name
that is renamed when it is whole (a task that runs again writes the same archive again),
and rolled at ``roll_bytes``, which bounds what a reading task holds. They are read back
by Spark's ``binaryFile`` source.

Cases: null html is an empty payload; a null url is written as an empty target; pages
tied on the largest id (repeated rows) are all responses; pages with a null id take part
with the id left out of the record; an empty table makes no archive and no rows; extra
columns do not reach the records.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, run_folder, save_file, written

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

MIN_REVISIT = 1000
ROLL_BYTES = 16 << 20
#: The dictionary is trained on so many bytes of the first payloads of an archive.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
DATE = "2024-01-01T00:00:00Z"


class BadRecord(ValueError):
    """A record or archive that is not well formed."""


# ------------------------------------------------------------------ one record
def sha1_header(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, validated."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise BadRecord("no end of headers")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise BadRecord("version line")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise BadRecord("header line")
        if name.lower() in headers:
            raise BadRecord(f"repeated header {name}")
        headers[name.lower()] = value.strip()
    for name in MANDATORY:
        if name not in headers:
            raise BadRecord(f"no {name}")
    if not headers["content-length"].isdigit():
        raise BadRecord("content-length")
    n = int(headers["content-length"])
    if len(rest) != n + 4:
        raise BadRecord("block length")
    if rest[n:] != b"\r\n\r\n":
        raise BadRecord("record trailer")
    block = rest[:n]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != sha1_header(block):
        raise BadRecord("block digest")
    return headers, block


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        raise BadRecord("http header")
    return payload


def page_record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    name = "" if page_id is None else str(page_id)
    common = [("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target),
              ("WARC-Payload-Digest", sha1_header(payload)), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        extra = [("WARC-Type", "revisit"), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        return build_record(extra + common + [("WARC-Block-Digest", sha1_header(head))], head)
    block = head + payload
    return build_record([("WARC-Type", "response"), *common, ("WARC-Block-Digest", sha1_header(block))], block)


# ------------------------------------------------------------------ one archive
def write_archive(records: list[bytes], sample: list[bytes]) -> bytes:
    """The bytes of an archive. The dictionary is trained on ``sample``; where that is
    too small or uniform to train on, its raw bytes serve as the dictionary."""
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:
        dictionary = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or VERSION * 2,
                                                   dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    frames = [compressor.compress(r) for r in records]
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(frames)


def read_archive(data: bytes):
    """``(offset, record bytes or None, error or None)`` for each frame of an archive."""
    view = memoryview(data)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        yield 0, None, "no dictionary frame"
        return
    size = struct.unpack_from("<I", data, 4)[0]
    raw = bytes(view[8:8 + size])
    if len(raw) != size:
        yield 0, None, "dictionary cut short"
        return
    if raw[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    at, dictionary = 8 + size, zstandard.ZstdCompressionDict(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if bytes(view[at:at + 4]) != FRAME_MAGIC:
            yield at, None, "no frame"
            return
        one = decompressor.decompressobj()
        parts, used, step = [], at, 1 << 16
        try:
            while not one.eof and used < len(data):
                parts.append(one.decompress(view[used:used + step]))
                used += step
        except zstandard.ZstdError as e:
            yield at, None, f"frame: {e}"
            nxt = data.find(FRAME_MAGIC, at + 4)
            if nxt < 0:
                return
            at = nxt
            continue
        if not one.eof:
            yield at, None, "frame cut short"
            return
        end = min(used, len(data)) - len(one.unused_data)
        yield at, b"".join(parts), None
        at = end


# ------------------------------------------------------------------ tables
def plan_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages that become revisits, one row each."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    ids = written(pages.where(F.octet_length(payload) >= min_revisit)
                  .select("page_id", F.sha1(payload).alias("digest")), "payload-ids")
    last = (ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
            .where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to"))
    return ids.join(last, "digest").where("page_id <> refers_to").distinct()


def write_pages(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record per page; gives ``archive, records``, one row per archive."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    src = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = src.join(plan_revisits(pages, min_revisit), ["page_id", "digest"], "left")

    def run(batches):
        from pyspark import TaskContext
        task, number = TaskContext.get().partitionId(), 0
        records, size, sample, sampled = [], 0, [], 0

        def flush():
            name = f"pages-{task:06d}-{number:04d}.warc.zst"
            save_file(folder, name, write_archive(records, sample))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64())], ["archive", "records"])

        for batch in batches:
            for page_id, url, body, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                record = page_record(page_id.as_py(), url.as_py(), body.as_py(), refers.as_py())
                records.append(record)
                size += len(record)
                if sampled < SAMPLE_BYTES:
                    sample.append(record[:65536])
                    sampled += len(sample[-1])
                if size >= roll_bytes:
                    yield flush()
                    number += 1
                    records, size, sample, sampled = [], 0, [], 0
        if records:
            yield flush()

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, records bigint")


_READ = pa.schema([("archive", pa.string()), ("frame_at", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
                   ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()),
                   ("refers_to", pa.int64()), ("error", pa.string())])


def _page_number(name: str):
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _read_row(archive: str, at: int, record):
    headers, block = parse_record(record)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        raise BadRecord(f"type {kind}")
    body = http_payload(block)
    digest = headers.get("warc-payload-digest", "")
    refers = None
    if kind == "response":
        if digest and digest != sha1_header(body):
            raise BadRecord("payload digest")
        digest = hashlib.sha1(body).hexdigest()
    else:
        refers = _page_number(headers.get("warc-refers-to", ""))
        if refers is None or headers.get("warc-profile") != REVISIT_PROFILE or not digest.startswith("sha1:"):
            raise BadRecord("revisit headers")
        body, digest = None, base64.b32decode(digest[5:]).hex()
    return (archive, at, _page_number(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, body, digest, refers, None)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the folder's archives, or its error (columns of ``_READ``)."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                name = path.as_py().rsplit("/", 1)[-1]
                for at, record, error in read_archive(content.as_py()):
                    try:
                        if error:
                            raise BadRecord(error)
                        rows.append(_read_row(name, at, record))
                    except BadRecord as e:
                        rows.append((name, at, None, None, None, None, None, None, str(e)))
                    size += len(record or b"")
                    if size > 8 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(run, "archive string, frame_at bigint, page_id bigint, url string, record_type string, "
                                 "payload binary, payload_digest string, refers_to bigint, error string")


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the pages, read the archives back, and give each page's record with the
    length of its full payload; a revisit takes it from the response that it names,
    whose digest must agree."""
    folder = run_folder(spark, "warc")
    done = written(write_pages(pages.select("page_id", "url", "html"), folder, min_revisit), "warc-index")
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if not done.limit(1).count():
        return spark.createDataFrame([], schema)
    back = written(read_pages(spark, folder).select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", "record_type",
        "refers_to", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).cast("string").alias("error")), "warc-records")
    named = back.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    whole = (back.where("record_type = 'response'").join(named, "page_id", "left_semi")
             .groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full_bytes")))
    out = back.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    again = back.where("record_type = 'revisit'").join(whole, ["refers_to", "payload_digest"]).select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return out.unionByName(again)


def op4_warc_round_trip(spark, sf_dir):
    return round_trip(spark, read(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS s FROM pages),
     d AS (SELECT page_id, octet_length(encode(s)) AS payload_bytes, sha1(s) AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
