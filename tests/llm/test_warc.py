import hashlib
import io
import struct

import pytest
import zstandard

from verity.llm import warc
from verity.session import scratch_path

from .helpers import SF, with_clashes

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in rows:
        again = p is not None and h in first and first[h] < p
        out.append((p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(),
                    "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def run(spark, df):
    got = warc.archive_and_read(df, scratch_path(spark, "t")).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)


EDGE = [(1, "http://a/", "x" * 100), (2, "http://b/", "x" * 100), (3, None, "x" * 99), (4, "u\r\nWARC-Type: x", "x" * 99),
        (5, "", None), (6, "ü", ""), (7, "c", "é" * 50), (8, "c", "é" * 50), (None, "n", "x" * 100), (1, "http://a/", "x" * 100),
        (9, "l", "long\r\n\r\n" * 200_000)]


def test_same_as_brute_force(spark):
    rows = EDGE + [(r.page_id + 100, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert run(spark, with_clashes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert run(spark, spark.createDataFrame([], SCHEMA)) == []


def test_archives_are_plain_zstandard(spark):
    """Any reader of the format gets the records: leading dictionary, one frame a record, empty frames between."""
    out = scratch_path(spark, "t")
    df = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(df, out)
    n, led = 0, 0
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).where("length > 0").collect():
        data = bytes(r.content)
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_MAGIC
        led += size > 0
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]) if size else None)
        text = d.stream_reader(io.BytesIO(data), read_across_frames=True).read()
        n += text.count(b"WARC/1.1\r\n")
    assert n == df.count() and led


def test_payloads(spark):
    out = scratch_path(spark, "t")
    warc.write_archives(spark.createDataFrame(EDGE, SCHEMA), out)
    got = {r.page_id: r.payload for r in warc.read_archives(spark, out, payloads=True).collect() if r.page_id}
    assert bytes(got[9]) == b"long\r\n\r\n" * 200_000 and got[2] is None and bytes(got[7]).decode() == "é" * 50


def archive(*records, dictionary=b""):
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.dictionary_frame(dictionary) + b"".join(c.compress(r) for r in records)


GOOD = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest())


def test_reader_refuses_what_is_wrong():
    data = archive(GOOD, GOOD)
    assert len(list(warc.frames(data))) == 2
    for bad in (data[:-3], data[:20], b"junk" + data, data + b"tail56789", data[8:][:-1],
                archive(GOOD) + warc.dictionary_frame(b"late")):
        with pytest.raises(ValueError):
            list(warc.frames(bad))
    for bad in (GOOD[:-1], GOOD + b" ", GOOD.replace(b"WARC/1.1", b"WARC/9.9"), GOOD.replace(b"WARC-Date", b"X Date"),
                GOOD.replace(b"WARC-Type: response\r\n", b""), GOOD.replace(b"WARC-Type", b"WARC-Date")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    headers, block = warc.parse_record(GOOD.replace(b"payload\r\n\r\n", b"Payload\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.parse_http(headers, block)


def test_compressed_dictionary():
    pages = [(f"<html><p>{i} some words {i * 7} of a page</p></html>" * 5).encode() for i in range(300)]
    d = zstandard.train_dictionary(2000, pages).as_bytes()
    packed = zstandard.ZstdCompressor().compress(d)
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + c.compress(GOOD)
    assert list(warc.frames(data)) == [GOOD]


def test_archives_are_bounded(spark):
    """With a tiny bound a task writes many archives, each of which leads with the dictionary; nothing is lost."""
    rows = EDGE + [(r.page_id + 100, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    out = scratch_path(spark, "t")
    got = warc.archive_and_read(spark.createDataFrame(rows, SCHEMA).coalesce(2), out, archive_bytes=4000).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).where("length > 0").collect()
    assert len(files) > 6
    assert all(struct.unpack_from("<I", bytes(f.content))[0] == warc.DICTIONARY_MAGIC for f in files)


def test_frame_of_undeclared_size():
    """Frames written as a stream do not say how long their content is."""
    raw = warc.record(1, "u", b"x" * 5_000_000, hashlib.sha256(b"x" * 5_000_000).hexdigest())
    c = zstandard.ZstdCompressor().compressobj()
    frame = c.compress(raw) + c.flush()
    assert zstandard.get_frame_parameters(frame).content_size in (-1, 2**64 - 1)
    assert list(warc.frames(frame)) == [raw]
