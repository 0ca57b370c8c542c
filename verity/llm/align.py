"""Alignment of two tokenizers (operator 11).

Both cut the same bytes: tokenizer A those of a space and the text, tokenizer B the same, as it puts the space in front
itself.  Byte offsets where a token of each ends are shared cuts, and cut the tokens into groups.  They are found by divide and
conquer: of an interval, the A tokens' ends are tried from the middle outwards, each looked up among the B tokens' ends by
bisection; at a shared one the interval is parted, and both halves go on.  An interval without any is a leaf: a group.  All
intervals of a batch take a step together, so a step is a few numpy operations.

Where a space stands alone between other characters both tokenizers end a token before it (their files are checked), so a
text is parted there first, and equal parts are encoded and aligned once a batch.

An id pair's count is the number of documents that hold it linked.  A chunk of documents lists its distinct pairs with its own
counts; Spark sums them and sends each chunk the counts of its pairs.  What goes back is bounded by the chunk, and no
document meets a list of all pairs.  The best count of an A id is a table of one row for each id of the vocabulary.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Pieces, col, loose, materialize, parts_of, ragged, ship, tidy

STEP_BYTES = 4 << 20         # text that is aligned at a time
CHUNK_BYTES = 32 << 20       # text of one chunk
CACHE_PARTS = 300_000        # parts whose ids a Python worker remembers
ENCODE = 4000                # parts that the library gets at a time


# ---------------------------------------------------------------- divide and conquer

def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, a_of: np.ndarray, b_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of two tokenizations: for each group its first A token and its first B token, in order.

    ``a_end`` and ``b_end`` are ascending ends in one axis of bytes.  Text i has the A tokens a_of[i] .. a_of[i + 1] and the B tokens
    b_of[i] .. b_of[i + 1], at least one of each, and its last tokens end together.
    """
    alo, ahi, blo, bhi = a_of[:-1], a_of[1:], b_of[:-1], b_of[1:]
    step = np.zeros(len(alo), np.int64)               # ends that were tried in the interval
    leaf_a, leaf_b = [], []
    while len(alo):
        inner = ahi - alo - 1                         # ends inside the interval
        done = (step >= inner) | (bhi - blo < 2)
        if done.any():
            leaf_a.append(alo[done]), leaf_b.append(blo[done])
            go = ~done
            alo, ahi, blo, bhi, step, inner = (x[go] for x in (alo, ahi, blo, bhi, step, inner))
        # 0, +1, -1, +2, ... from the middle; past an edge the other side goes on alone
        half, out = (inner - 1) // 2, (step + 1) // 2
        reach = np.minimum(half, inner - 1 - half)
        j = np.where(out <= reach, np.where(step % 2 == 1, half + out, half - out),
                     np.where(half < inner - 1 - half, step, inner - 1 - step)) + alo
        at = np.searchsorted(b_end, a_end[j])         # the B token that ends there or is the first to end behind it
        cut = b_end[np.minimum(at, len(b_end) - 1)] == a_end[j]
        new = np.zeros(int(cut.sum()), np.int64)
        alo, ahi, blo, bhi, step = (np.concatenate(x) for x in (
            (alo[~cut], alo[cut], j[cut] + 1), (ahi[~cut], j[cut] + 1, ahi[cut]), (blo[~cut], blo[cut], at[cut] + 1),
            (bhi[~cut], at[cut] + 1, bhi[cut]), (step[~cut] + 1, new, new)))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (leaf_a, leaf_b))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def links(a_end: np.ndarray, b_end: np.ndarray, a_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all pairs whose byte ranges overlap, in order; both cut the same bytes."""
    first = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_end, a_end) - first + 1
    return np.repeat(np.arange(len(a_end)), n), ragged(first, n)


# ---------------------------------------------------------------- tokenizers

def _ends(a: pa.Array) -> np.ndarray:
    """The offsets of a string or binary array."""
    return np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset).astype(np.int64) if len(a) else np.zeros(1, np.int64)


class Both:
    """Two tokenizers of the same text, part by part.

    ``path_a`` is a byte-level BPE of the tokenizers library, ``path_b`` a sentencepiece BPE that adds the space in front.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from .bpe import byte_letters
        from .lengths import JsonLengths, ModelLengths
        a, b = JsonLengths(path_a), ModelLengths(path_b)
        if not a.safe or not b.safe:
            raise ValueError("these tokenizers do not both end a token before a lone space")
        self.a, self.b = a.tokenizer, b.model
        self.a.encode_special_tokens = True           # their strings in a text are plain text
        byte = {c: i for i, c in enumerate(byte_letters())}
        size = self.a.get_vocab_size(with_added_tokens=True)
        tokens = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = pa.array([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens], pa.binary())
        self.width = self.b.get_piece_size()
        self.bytes_b = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                 for i, p in enumerate(map(self.b.id_to_piece, range(self.width)))], pa.binary())
        self.size_a, self.size_b = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (self.bytes_a, self.bytes_b))
        # decimal ids with the sign that follows: "," or the one that ends a side of a group
        self.signs_a = pa.array([f"{i}{s}" for s in ",|" for i in range(size)], pa.string())
        self.signs_b = pa.array([f"{i}{s}" for s in ",;" for i in range(self.width)], pa.string())
        self.cache: dict[str, bytes] = {}

    def known(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the parts by A and where each part's begin (and the last end), and the same by B."""
        cache = self.cache
        new = [p for p in parts if p not in cache]
        if len(cache) + len(new) > CACHE_PARTS:
            cache = self.cache = {p: cache[p] for p in parts if p in cache}          # what is in use stays
        for at in range(0, len(new), ENCODE):
            some = new[at:at + ENCODE]
            e = self.a.encode([" " + p for p in some], is_pretokenized=True, add_special_tokens=False)
            lists = self.b.encode(some, num_threads=1)
            n_a = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
            n_b = np.fromiter(map(len, lists), np.int64, len(lists))
            # a part's entry: how many ids A has, they, those of B
            end = np.cumsum(1 + n_a + n_b)
            start = end - 1 - n_a - n_b
            flat = np.empty(int(end[-1]), "<u4")
            flat[start] = n_a
            flat[ragged(start + 1, n_a)] = e.ids
            flat[ragged(start + 1 + n_a, n_b)] = np.fromiter(chain.from_iterable(lists), np.uint32, int(n_b.sum()))
            data = flat.tobytes()
            cache.update(zip(some, (data[x:y] for x, y in zip((4 * start).tolist(), (4 * end).tolist(), strict=True)), strict=True))
        packed = [cache[p] for p in parts]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        start = np.cumsum(size) - size
        n_a = flat[start]
        n_b = size - 1 - n_a
        return (flat[ragged(start + 1, n_a)], np.concatenate([[0], np.cumsum(n_a)]),
                flat[ragged(start + 1 + n_a, n_b)], np.concatenate([[0], np.cumsum(n_b)]))

    def same(self, table: pa.Array, sizes: np.ndarray, ids: np.ndarray, off: np.ndarray, want: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the tokens' bytes, joined, are those wanted, part by part."""
        at = np.concatenate([[0], np.cumsum(sizes[ids])])[off]
        data = np.frombuffer(table.take(pa.array(ids)).buffers()[2], np.uint8, int(at[-1])) if len(ids) else np.zeros(0, np.uint8)
        good = np.diff(at) == np.diff(ends)
        n = np.diff(ends)[good]
        differ = np.concatenate([[0], np.cumsum(data[ragged(at[:-1][good], n)] != want[ragged(ends[:-1][good], n)])])
        stop = np.cumsum(n)
        good[good] = differ[stop] == differ[stop - n]
        return good


class Parts:
    """The distinct parts of some texts, aligned."""

    def __init__(self, both: Both, values: list[str]):
        n = len(values)
        ids_a, off_a, ids_b, off_b = both.known(values)
        spaced = [b" " + v.encode() for v in values]
        want = np.frombuffer(b"".join(spaced), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, spaced), np.int64, n))])
        self.good = both.same(both.bytes_a, both.size_a, ids_a, off_a, *want) & both.same(both.bytes_b, both.size_b, ids_b, off_b, *want)
        # only parts whose bytes agree are aligned
        self.n_a, self.n_b = np.diff(off_a) * self.good, np.diff(off_b) * self.good
        ids_a, ids_b = ids_a[np.repeat(self.good, np.diff(off_a))], ids_b[np.repeat(self.good, np.diff(off_b))]
        some = np.flatnonzero(self.good)
        a_of, b_of = (np.concatenate([[0], np.cumsum(x[some])]) for x in (self.n_a, self.n_b))
        a_end, b_end = np.cumsum(both.size_a[ids_a]), np.cumsum(both.size_b[ids_b])
        first_a, first_b = shared_cuts(a_end, b_end, a_of, b_of)
        owner = some[np.searchsorted(a_of, first_a, "right") - 1] if len(some) else np.zeros(0, np.int64)
        self.n_groups = np.bincount(owner, minlength=n)
        # links, and the pairs of ids that they are
        x, y = links(a_end, b_end, a_end - both.size_a[ids_a])
        pair_owner = some[np.searchsorted(a_of, x, "right") - 1] if len(some) else np.zeros(0, np.int64)
        self.n_links = np.bincount(pair_owner, minlength=n)
        self.pairs, self.pair = np.unique(ids_a[x] * both.width + ids_b[y], return_inverse=True)
        self.pair_off = np.concatenate([[0], np.cumsum(self.n_links)])
        self.text = self._signs(both, ids_a, ids_b, first_a, first_b, owner, n)

    def _signs(self, both, ids_a, ids_b, first_a, first_b, owner, n) -> pa.Array:
        """For each part, its groups as text, each with the semicolon that ends it."""
        if not len(first_a):
            return pa.array([""] * n, pa.string())
        g_a, g_b = np.diff(np.append(first_a, len(ids_a))), np.diff(np.append(first_b, len(ids_b)))
        start = np.cumsum(g_a + g_b) - g_a - g_b                      # where a group's tokens lie when written out
        at_a, at_b = ragged(start, g_a), ragged(start + g_a, g_b)
        end_a, end_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        end_a[first_a + g_a - 1], end_b[first_b + g_b - 1] = 1, 1
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[at_a] = ids_a + end_a * (len(both.signs_a) // 2)
        order[at_b] = len(both.signs_a) + ids_b + end_b * (len(both.signs_b) // 2)
        flat = pa.concat_arrays([both.signs_a, both.signs_b]).take(pa.array(order))
        ends = _ends(flat)
        tokens = np.bincount(owner, g_a + g_b, n).astype(np.int64)
        off = ends[np.concatenate([[0], np.cumsum(tokens)])]
        return pa.StringArray.from_buffers(n, pa.py_buffer(off.astype(np.int32)), flat.buffers()[2])


@lru_cache(1)
def both(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


# ---------------------------------------------------------------- chunks of documents

class Chunk:
    """Documents on the way: their parts by number, and the distinct parts' pairs."""

    def __init__(self):
        self.docs, self.parts, self.size = [], [], 0

    def add(self, b: Both, doc_ids: pa.Array, text: pa.Array) -> None:
        """Align some texts and keep what is needed for their sums."""
        p = Pieces(text)
        done = Parts(b, p.values.to_pylist())
        n = len(text)
        size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        count = np.diff(p.offsets)
        doc = np.repeat(np.arange(n), count)
        good = (size > 0) & (np.bincount(doc[~done.good[p.codes]], minlength=n) == 0)
        keep = good[doc]
        doc, code = doc[keep], p.codes[keep]
        sums = [np.bincount(doc, x[code], n).astype(np.int64) for x in (done.n_a, done.n_b, done.n_groups, done.n_links)]
        # groups as text: the parts' own, one after the other, without the last sign
        flat = done.text.take(pa.array(code))
        ends = _ends(flat)
        at = ends[np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])].tolist()
        data = memoryview(flat.buffers()[2]) if len(code) else b""
        sha = [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]
        # each document's distinct parts, and how often it has them
        key, times = np.unique(doc * len(done.good) + code, return_counts=True)
        doc, code = key // len(done.good), key % len(done.good)
        # documents that hold a pair: of the pairs of a document's distinct parts, each once
        held = np.zeros(len(done.pairs), np.int64)
        for lo, hi in _runs(doc, done.n_links[code]):
            m = done.n_links[code[lo:hi]]
            pair = done.pair[ragged(done.pair_off[code[lo:hi]], m)]
            held += np.bincount(np.unique(np.repeat(doc[lo:hi], m) * len(done.pairs) + pair) % max(len(done.pairs), 1), minlength=len(done.pairs))
        used = np.unique(code)                        # parts of documents that count
        back = np.searchsorted(used, code)
        self.docs.append(pa.RecordBatch.from_arrays(
            [doc_ids, *(pa.array(x) for x in sums), pa.array(sha, pa.string()),
             pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(back.astype(np.uint32))),
             pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(times.astype(np.uint32)))],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "part", "times"]))
        m = done.n_links[used]
        live = held > 0
        place = np.cumsum(live) - 1
        self.parts.append((done.pairs[live], held[live], m, place[done.pair[ragged(done.pair_off[used], m)]]))
        self.size += int(size.sum())

    def row(self, name: str) -> pa.RecordBatch:
        """The chunk: its distinct pairs with the documents that hold them, and the rest in two packed tables."""
        pairs, back = np.unique(np.concatenate([p for p, _, _, _ in self.parts]), return_inverse=True)
        held = np.bincount(back, np.concatenate([h for _, h, _, _ in self.parts]), len(pairs)).astype(np.int64)
        tables, at = [], 0
        for p, _, m, pair in self.parts:
            own = back[at:at + len(p)][pair]
            at += len(p)
            tables.append(pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m)]), pa.int32()), pa.array(own.astype(np.uint32)))], ["pair"]))
        one = pa.array([0, len(pairs)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.ListArray.from_arrays(one, pa.array(pairs)), pa.ListArray.from_arrays(one, pa.array(held)),
             pa.array([_packed(self.docs)], pa.binary()), pa.array([_packed(tables)], pa.binary())], ["chunk", "pairs", "held", "docs", "parts"])


def _runs(doc: np.ndarray, cost: np.ndarray, most: int = 1 << 21):
    """Runs of rows that hold whole documents and about ``most`` of the cost each."""
    total, lo = np.concatenate([[0], np.cumsum(cost)]), 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most)) - 1)
        hi = int(np.searchsorted(doc, doc[min(hi, len(doc)) - 1], "right"))
        yield lo, hi
        lo = hi


def _packed(batches: list[pa.RecordBatch]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)
    return out.getvalue().to_pybytes()


def _chunks(path_a: str, path_b: str, most: int):
    def run(batches):
        pid, number, chunk = TaskContext.get().partitionId(), 0, Chunk()
        for batch in batches:
            for at, n in parts_of(batch.column(1), STEP_BYTES):
                chunk.add(both(path_a, path_b), batch.column(0).slice(at, n), batch.column(1).slice(at, n))
                if chunk.size >= most:
                    yield chunk.row(f"{pid}-{number}")
                    chunk, number = Chunk(), number + 1
            tidy()
        if chunk.docs:
            yield chunk.row(f"{pid}-{number}")
        both.cache_clear()                # a worker outlives its task
        tidy()
    return run


def _sums(batches):
    """Rows (docs, parts, counts, best) of chunks to the documents' results."""
    for batch in batches:
        for docs, parts, counts, best in zip(*batch.columns, strict=True):
            count = counts.values.to_numpy() if counts.is_valid else np.zeros(0, np.int64)
            top = best.values.to_numpy(zero_copy_only=False).astype(np.int64) if best.is_valid else np.zeros(0, np.int64)
            for d, p in zip(pa.ipc.open_stream(docs.as_buffer()), pa.ipc.open_stream(parts.as_buffer()), strict=True):
                pair, off = p.column(0).values.to_numpy(), p.column(0).offsets.to_numpy()
                of_part = [np.diff(np.concatenate([[0], np.cumsum(x[pair])])[off]) for x in (count, top)]
                part, times, off = d.column(6).values.to_numpy(), d.column(7).values.to_numpy().astype(np.int64), d.column(6).offsets.to_numpy()
                total, hits = (np.diff(np.concatenate([[0], np.cumsum(x[part] * times)])[off]) for x in of_part)
                yield pa.RecordBatch.from_arrays([*d.columns[:5], pa.array(hits), pa.array(total), d.column(5)],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or whose tokens' bytes by A or by B do not join to a space and the text, have no tokens: zeros,
    and an empty groups_sha256.  Special tokens' strings are plain text.  A row is a document: rows that repeat one count each.
    Null ids are passed through; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    width = both(path_a, path_b).width
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    chunks = materialize(rows.mapInArrow(_chunks(path_a, path_b, chunk_bytes),
                                         "chunk string, pairs array<long>, held array<long>, docs binary, parts binary"), "chunks")
    counts = materialize(chunks.select(F.explode(F.arrays_zip("pairs", "held")).alias("z")).groupBy(F.col("z.pairs").alias("pair"))
                         .agg(F.sum("z.held").alias("count")), "pairs")
    of_a = F.floor(F.col("pair") / F.lit(width)).cast("long")
    best = counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("top"))        # a row for each id of A's vocabulary at most
    known = counts.withColumn("a", of_a).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    asked = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(loose(known, "pair"), "pair").groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("s")).select("chunk", F.col("s.count").alias("counts"), F.col("s.best").alias("best"))
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return chunks.select("chunk", "docs", "parts").join(answers, "chunk", "left").select("docs", "parts", "counts", "best").mapInArrow(_sums, schema)
