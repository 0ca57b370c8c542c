"""Token ids in bit-packed binary files (operator 3).

Texts are encoded with the ``tokenizers`` library, an end id closes each document, and the
ids go to files in ascending document order.  An id takes the fewest bits that the
vocabulary needs.

A file is a row of segments, one newline byte after each.  A segment is

    header  8s magic, u32 bits, u32 ids per block, u64 part, u64 number in the part,
            u64 documents, u64 ids, u64 packed bytes            (little-endian)
    table   i64 id, u8 is-null, u64 number of ids: one array each, over the documents
    blocks  u64 offsets of the blocks and of their end, in the packed bytes
    packed  blocks of ids, least significant bit first, each from a byte's start

Any ids can be read by unpacking only their blocks with numpy (``Segment.ids``).
The files are written by Spark's text sink, whose commit protocol survives lost executors
and which writes to any store; rows are bytes, and the line separator is the newline.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, materialize, parts_of, ragged, ship, tidy

MAGIC = b"IDPACK1\0"
HEADER = struct.Struct("<8sIIQQQQQ")
BLOCK_IDS = 1 << 14
SEGMENT_IDS = 1 << 20     # a segment closes after the document that reaches this many ids
SEGMENTS_PER_FILE = 64    # keeps a file far below what one task can hold
TIDY_EVERY = 4            # batches between two returns of freed memory
STEP_BYTES = 8 << 20       # text that is encoded at a time
CACHE_WORDS = 700_000     # pieces of text whose ids a Python worker remembers

_SPACES = r"\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSAFE = f"[ {_SPACES}] | [{_SPACES}]|^ | $"     # a space beside white space or an edge
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


# ---------------------------------------------------------------- bit packing

def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell ids 0 .. vocabulary - 1 apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first."""
    if bits == 16:                                            # the same bytes, without the detour
        return ids.astype("<u2").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(raw[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data, bits: int, n: int) -> np.ndarray:
    """The first n ids of what ``pack`` wrote."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    raw = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = raw
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def segment(part: int, number: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """The bytes of one segment."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits than the vocabulary has")
    blocks = [pack(ids[a:a + BLOCK_IDS], bits) for a in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)])
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([HEADER.pack(MAGIC, bits, BLOCK_IDS, part, number, len(doc_ids), len(ids), int(offsets[-1])),
                     np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(),
                     sizes.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class Segment:
    """A segment at ``at`` in a buffer (bytes, or a memory-mapped file): tables read, ids unpacked on demand."""

    def __init__(self, data, at: int = 0):
        self.data = memoryview(data)
        magic, self.bits, self.block, self.part, self.number, self.n_docs, self.n_ids, packed = \
            HEADER.unpack_from(self.data, at)
        if magic != MAGIC or not 1 <= self.bits <= 32:
            raise ValueError("not a segment of packed ids")
        n, at = self.n_docs, at + HEADER.size
        self.doc_ids = np.frombuffer(self.data, "<i8", n, at)
        self.null = np.frombuffer(self.data, np.uint8, n, at + 8 * n)
        self.sizes = np.frombuffer(self.data, "<u8", n, at + 9 * n).astype(np.int64)
        at += 17 * n
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.body = at + 8 * (n_blocks + 1)
        self.end = self.body + packed
        if self.sizes.sum() != self.n_ids or self.offsets[-1] != packed or self.end > len(self.data):
            raise ValueError("a segment's tables do not agree with its length")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1 of the segment; only the blocks that hold them are unpacked."""
        first, last = start // self.block, -(-stop // self.block)
        out = [unpack(self.data[self.body + self.offsets[b]:self.body + self.offsets[b + 1]], self.bits,
                      min(self.block, self.n_ids - b * self.block)) for b in range(first, last)]
        flat = np.concatenate(out) if out else np.zeros(0, np.uint32)
        return flat[start - first * self.block:stop - first * self.block]


def segments(data):
    """The segments of one file, in order."""
    at = 0
    while at < len(data):
        s = Segment(data, at)
        yield s
        at = s.end + 1                # the separator


# ---------------------------------------------------------------- encoding

class PieceCoder:
    """Encodes texts with the library, each distinct piece once.

    In this tokenizer a space that stands alone between two words starts the second word's token, and
    punctuation after a letter or digit starts a new one.  So a text is cut at such spaces, and a word from
    the marks that end it; its ids are those of the pieces, with the space before all but the first.  Spaces beside
    other white space or at an edge are not cut at.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from .lengths import JsonLengths
        library = JsonLengths(path)
        if not library.safe:
            raise ValueError("not a byte-level tokenizer that starts a token at every lone space")
        self.tokenizer = library.tokenizer
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        forget = getattr(self.tokenizer.model, "_resize_cache", None)
        if forget:                    # words are remembered here; the library need not do so as well
            forget(0)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache: dict[str, bytes] = {}

    def known(self, pieces: list[str]) -> list[bytes]:
        """Ids (32-bit) of each piece."""
        cache = self.cache
        new = [p for p in pieces if p not in cache]
        if len(cache) + len(new) > CACHE_WORDS:
            cache = self.cache = {p: cache[p] for p in pieces if p in cache}    # what is in use stays
        for at in range(0, len(new), 4000):
            some = new[at:at + 4000]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            to = (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some) + 1))).tolist()
            ids = np.array(e.ids, "<u4").tobytes()
            cache.update(zip(some, (ids[a:b] for a, b in zip(to[:-1], to[1:], strict=True)), strict=True))
        return [cache[p] for p in pieces]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts (null: empty) and the offsets of each text's ids."""
        text = pc.fill_null(text, "")
        lists = pc.split_pattern(text, " ")
        odd = np.flatnonzero(pc.match_substring_regex(text, _UNSAFE).to_numpy(zero_copy_only=False))
        if len(odd):
            own = pa.array([_SAFE_SPACE.split(text[i].as_py()) for i in odd.tolist()], lists.type)
            order = np.arange(len(text))
            order[odd] = len(text) + np.arange(len(odd))
            lists = pa.concat_arrays([lists, own]).take(pa.array(order))
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, values = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        # distinct pieces as word and marks, where the word is of letters and digits only
        word = pc.utf8_rtrim(values, characters=_MARKS)
        marked = pc.and_(pc.utf8_is_alnum(word), pc.not_equal(word, values))
        word = pc.if_else(marked, word, values).dictionary_encode()
        marks = pc.if_else(marked, pc.utf8_slice_codeunits(values, 0), pa.scalar("", pa.string()))
        size = pc.utf8_length(word.dictionary.take(word.indices)).to_numpy()
        tails = [v[n:] if v else "" for v, n in zip(marks.to_pylist(), size.tolist(), strict=True)]
        tail = pa.array(tails, pa.string()).dictionary_encode()
        first = np.unique(codes[at[:-1]])                       # pieces that start a text have no space before them
        whole = values.take(pa.array(first)).to_pylist()
        n_words, n_tails = len(word.dictionary), len(tail.dictionary)
        packed = self.known([" " + w for w in word.dictionary.to_pylist()]) + \
            [b"" if not t else x for t, x in zip(tail.dictionary.to_pylist(), self.known(tail.dictionary.to_pylist()), strict=True)] + \
            self.known(whole)
        head = word.indices.to_numpy().astype(np.int64)[codes]
        end = n_words + tail.indices.to_numpy().astype(np.int64)[codes]
        blank = n_words + tail.dictionary.index("").as_py() if "" in tails else 0
        head[at[:-1]] = n_words + n_tails + np.searchsorted(first, codes[at[:-1]])
        length = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        end[at[:-1]] = blank
        two = np.stack([head, end], axis=1).reshape(-1)
        n = length[two]
        if "" not in tails:
            n[2 * at[:-1] + 1] = 0
        table = np.frombuffer(b"".join(packed), "<u4")
        begin = np.cumsum(length) - length
        return table[ragged(begin[two], n)], np.concatenate([[0], np.cumsum(n)])[2 * at]


@lru_cache(2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def _write_part(path: str, end_id: int):
    def run(batches):
        c, part, number = coder(path), TaskContext.get().partitionId(), 0
        bits = bits_for(max(c.vocabulary, end_id + 1))
        docs, sizes, ids, held = [], [], [], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([segment(
                part, number, docs, np.concatenate(sizes), np.concatenate(ids), bits)], pa.binary())], ["segment"])

        for k, batch in enumerate(batches):
            if k % TIDY_EVERY == TIDY_EVERY - 1:
                tidy()
            for at, n in parts_of(batch.column(1), STEP_BYTES):
                flat, off = c.encode(batch.column(1).slice(at, n))
                flat = np.insert(flat, off[1:], end_id)
                off = off + np.arange(len(off))
                names, a = batch.column(0).slice(at, n).to_pylist(), 0
                while a < n:
                    b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + SEGMENT_IDS - held))))
                    docs += names[a:b]
                    sizes.append(np.diff(off[a:b + 1]))
                    ids.append(flat[off[a]:off[b]])
                    held += int(off[b] - off[a])
                    if held >= SEGMENT_IDS:
                        yield close()
                        docs, sizes, ids, held, number = [], [], [], 0, number + 1
                    a = b
        if docs:
            yield close()
    return run


def write_ids(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = 0) -> None:
    """Encode ``docs`` and write the files to the folder ``out``.

    Documents are in ascending id order over all files (part, then number of the segment);
    null ids come first, and rows with equal ids are in the order of a hash of their texts.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
     .mapInArrow(_write_part(path, end_id), "segment binary").select(F.col("segment").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(out))


def _read_parts(batches):
    for batch in batches:
        for data in batch.column(0):
            for s in segments(data.as_buffer()):
                ids = s.ids(0, s.n_ids).astype("<u4")
                start = np.concatenate([[0], np.cumsum(s.sizes)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(s.n_docs, s.part, np.int64)), pa.array(np.full(s.n_docs, s.number, np.int64)),
                     pa.array(s.doc_ids, mask=s.null.astype(bool)), pa.array(start[:-1]), pa.array(s.sizes),
                     pa.array(crc, pa.int64())], ["part", "number", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files in ``out``: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: those in earlier parts, in earlier segments
    of the part, and in the segment.  The sums are over segments and parts, never over all documents in one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("content")
    rows = materialize(files.mapInArrow(
        _read_parts, "part long, number long, doc_id long, local long, n_tokens long, ids_crc32 long"), "ids")
    total = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    parts = total.groupBy("part").agg(F.sum("n").alias("n")).select(
        F.col("part").alias("p"),                                     # one row per part: few
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    at = total.withColumn("inside", before).join(parts, F.col("part") == F.col("p")) \
        .select("part", "number", (F.col("base") + F.col("inside")).alias("base"))
    return rows.join(at, ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 0) -> DataFrame:
    """Write the ids of ``docs`` to ``out`` and return what the files hold, one row per input row.

    A null or empty text has only the end id.  Null ids, repeated rows and ties are kept (see ``write_ids``);
    an empty table writes no segment and gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    write_ids(docs, out, path, id_col, text_col, end_id)
    return read_documents(docs.sparkSession, out)
