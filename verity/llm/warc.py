"""WARC files compressed with Zstandard (operator 4).

An archive begins with a skippable frame that carries the dictionary; then every record is
one frame.  Both are rows of Spark's text sink, which commits files safely to any store: its
line separator is set to the eight bytes of an empty skippable frame, which any
Zstandard reader passes over, so the files are plain ``.warc.zst`` archives.

Of records with equal payloads one holds the payload; the others are revisit records, which
name it and keep its HTTP head (with the payload's length) and digest.
"""

from __future__ import annotations

import hashlib
import re
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, ship

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)     # all ASCII: the sink's line separator
DATE = "1970-01-01T00:00:00Z"                       # fixed, so that archives are reproducible
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 32_768   # the dictionary's bounded sample
MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20       # an archive closes after the record that reaches this size


# ---------------------------------------------------------------- records

def record_id(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record.  With ``refers_to`` a revisit: the HTTP head without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:x-page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_HEADER_LINE = re.compile(r"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*?)[ \t]*")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; ValueError if anything is amiss."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        m = _HEADER_LINE.fullmatch(line)
        if not m:
            raise ValueError(f"bad header line {line[:80]!r}")
        if m[1].lower() in headers and m[1].lower() != "warc-concurrent-to":
            raise ValueError(f"header {m[1]} is repeated")
        headers[m[1].lower()] = m[2]
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"header {name} is missing")
    length = headers["content-length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the block has not the length that the header gives")
    return headers, rest[:-4]


def parse_http(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Of a response or revisit: payload bytes, digest, and the payload (None for a revisit), checked."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    fields = dict(_HEADER_LINE.fullmatch(x).groups() for x in head.decode("latin-1").split("\r\n")[1:])
    size = int({k.lower(): v for k, v in fields.items()}["content-length"])
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if not mark or not re.fullmatch("[0-9a-f]{64}", digest):
        raise ValueError("bad HTTP head or payload digest")
    if headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise ValueError("a revisit has a payload or names no record")
        return size, digest, None
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("the payload does not have the length and digest that its heads give")
    return size, digest, payload


# ---------------------------------------------------------------- frames

def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers; ValueError if it is cut off."""
    try:
        info = zstandard.get_frame_parameters(bytes(data[at:at + 18]))
        end = at + zstandard.frame_header_size(bytes(data[at:at + 18]))
    except zstandard.ZstdError as e:
        raise ValueError(f"bad frame: {e}") from None
    last = 0
    while not last:
        if end + 3 > len(data):
            raise ValueError("a frame is cut off")
        b = int.from_bytes(data[end:end + 3], "little")
        last, kind, size = b & 1, b >> 1 & 3, b >> 3
        if kind == 3:
            raise ValueError("bad block")
        end += 3 + (1 if kind == 1 else size)
    end += 4 * info.has_checksum
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def frames(data):
    """The records of one archive, decoded one frame at a time with the leading dictionary."""
    data, at, dictionary, reader = memoryview(data), 0, None, None
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("the archive is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC:
                if at or dictionary is not None:
                    raise ValueError("the dictionary does not lead the archive")
                dictionary = bytes(data[8:8 + size])
                if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):     # it may itself be compressed
                    dictionary = b"".join(zstandard.ZstdDecompressor().read_to_iter(dictionary))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        if reader is None:
            reader = zstandard.ZstdDecompressor(
                dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        end = frame_end(data, at)
        try:
            yield b"".join(reader.read_to_iter(data[at:end]))       # its size need not be declared
        except zstandard.ZstdError as e:
            raise ValueError(f"bad frame: {e}") from None
        at = end


# ---------------------------------------------------------------- Spark

def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from a bounded sample of payloads (empty if they are too few or too short)."""
    rows = pages.select(F.substring(col(html_col), 1, SAMPLE_BYTES).alias("h")).where("length(h) > 0").limit(SAMPLE_ROWS)
    samples = [r[0].encode() for r in rows.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _compress(dictionary: bytes, level: int, most: int):
    """Archives of about ``most`` bytes, one in a row."""
    def run(batches):
        c = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary)
                                     if dictionary else None)
        lead = dictionary_frame(dictionary)
        out, size = [lead], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])

        for b in batches:
            for page, url, html, digest, first in zip(*(b.column(i) for i in range(5)), strict=True):
                out.append(c.compress(record(page.as_py(), url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), first.as_py())))
                size += len(out[-1])
                if size >= most:
                    yield close()
                    out, size = [lead], 0
        if size:
            yield close()
    return run


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of ``pages`` to archives in ``out`` (a null payload is empty).

    A task writes as many archives as its records need, each with the dictionary in front, of about ``archive_bytes``.

    Which rows are revisits is found on digests alone (aggregated before they are shuffled); the payloads
    are joined with that by page id.  A null id is never the one that others refer to, and its row
    is always a response; rows that repeat the smallest id are all responses.
    """
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).alias("url"),
                        F.coalesce(col(html_col), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long = rows.where((F.octet_length("html") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    shared = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")) \
        .where("first < last").select(F.concat("digest", F.lit("")).alias("digest"), "first")   # a column of its own: see common.loose
    again = long.distinct().join(shared, "digest").where("page_id > first")
    marked = rows.join(again, ["page_id", "digest"], "left")
    dictionary = train_dictionary(pages, html_col)
    (marked.select("page_id", "url", "html", "digest", "first").mapInArrow(_compress(dictionary, level, archive_bytes), "archive binary")
     .select(F.col("archive").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", 1).text(out))


def _parse(payloads: bool):
    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for raw in frames(data.as_buffer()):
                    headers, block = parse_record(raw)
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    size, digest, payload = parse_http(headers, block)
                    page, to = (x and x.removeprefix("<urn:x-page:").removesuffix(">")
                                for x in (headers["warc-record-id"], headers.get("warc-refers-to")))
                    rows.append((None if page == "None" else int(page), headers.get("warc-target-uri"), size, digest,
                                 headers["warc-type"], to and int(to), payload if payloads else None))
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)
    return run


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("payload", pa.binary())])


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def read_archives(spark: SparkSession, out: str, payloads: bool = False, pattern: str = "part-*") -> DataFrame:
    """One row per response or revisit record of the archives in ``out``; a fault in an archive raises.

    An archive is read by one task, record by record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(out).where("length > 0").select("content")
    return files.mapInArrow(_parse(payloads), "page_id long, url string, payload_bytes long, payload_digest string, "
                                              "record_type string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url",
                     html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` to archives and return what they hold, one row per input row, payloads left out.

    Null payloads, null ids, ties and repeated rows: see ``write_archives``.  An empty table gives an empty
    result; other columns are ignored.
    """
    ship(pages.sparkSession)
    write_archives(pages, out, id_col, url_col, html_col, archive_bytes=archive_bytes)
    return read_archives(pages.sparkSession, out).drop("payload")
