"""Benchmark decontamination (operator 6).

Words are compared in lower case without punctuation.  For every length that a benchmark
item has, windows of that many words slide over the documents, wherever a word shingle of some
item occurs (a window that shares no shingle has similarity zero).  Each window gets a 64-bit
SimHash of its shingles.

Items whose fingerprint is within ``RADIUS`` bits are found by multi-index hashing: a
fingerprint is four blocks of 16 bits, and of two fingerprints within the radius some block
differs in at most RADIUS // 4 bits.  The index lists every item under all block values that
near, so a window's four lookups find all items within the radius, none is missed.  Candidates
are then verified exactly: the weighted Jaccard similarity of the shingle multisets (a shingle
weighs as often as it occurs) must reach ``SIMILARITY``.

Shingles have five words; an item or document with fewer words is one shingle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import Rolling, Words, col, fresh, materialize, mix, ship, slices, tidy

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
ITEMS_PER_PASS, SHINGLES_PER_PASS = 1000, 2_000_000   # what one pass over the documents sends to every task
_MARKS = re.compile(r"[\W_]+")
_ROLL = Rolling(0x9E3779B97F4A7C15)


class Bare:
    """The texts' words in lower case without punctuation: names, text offsets, and each word's place in its text."""

    def __init__(self, text: pa.Array):
        words = Words(text)
        bare = [_MARKS.sub("", v.lower()) for v in words.values.to_pylist()]
        own = np.fromiter((xxhash.xxh64_intdigest(b) for b in bare), np.uint64, len(bare))
        some = np.fromiter((bool(b) for b in bare), bool, len(bare))[words.codes] if bare else np.zeros(0, bool)
        self.names = own[words.codes[some]] if bare else np.zeros(0, np.uint64)
        self.offsets = np.concatenate([[0], np.cumsum(some)])[words.offsets].astype(np.int64)
        self.place = np.flatnonzero(some) - words.starts()[some]
        self.prefix = _ROLL.prefix(mix(self.names))

    def shingles(self, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words, also of those that cross texts."""
        i = np.arange(max(0, len(self.names) - size + 1))
        return _ROLL.span(self.prefix, i, i + size)


def simhash(counts: np.ndarray, total) -> np.ndarray:
    """Fingerprints from the numbers of shingles that set each bit (rows of 64)."""
    return np.packbits(2 * counts > total, axis=-1, bitorder="little").view("<u8").reshape(-1)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the least over sum of the greatest numbers of occurrences, over all values."""
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(i, minlength=len(both)) for i in (at[:len(a)], at[len(a):]))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1))


@lru_cache(4)
def _near_values(bits: int, most: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``most`` set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.int64)


class Index:
    """Benchmark items ready for search."""

    def __init__(self, items: list[tuple[int | str | None, int, np.ndarray]], shingle: int, radius: int, similarity: float):
        """``items``: id, number of words, shingle hashes in order."""
        self.items, self.shingle, self.radius, self.similarity = items, shingle, radius, similarity
        self.lengths = sorted({n for _, n, _ in items})
        self.sizes = sorted({min(shingle, n) for n in self.lengths})
        self.known = {k: np.unique(np.concatenate([h for _, n, h in items if min(shingle, n) == k])) for k in self.sizes}
        prints = np.array([int(simhash(_bits(h).sum(axis=0)[None], len(h))[0]) for _, _, h in items], np.uint64)
        self.prints = prints
        of_length = np.searchsorted(self.lengths, [n for _, n, _ in items]).astype(np.int64)
        masks = _near_values(16, radius // 4)
        keys, owners = [], []
        for block in range(4):
            value = (prints >> np.uint64(16 * block)).astype(np.int64) & 0xFFFF
            key = ((of_length * 4 + block) << 16)[:, None] | (value[:, None] ^ masks)
            keys.append(key.reshape(-1))
            owners.append(np.repeat(np.arange(len(items)), len(masks)))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order].astype(np.int32)

    def near(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius among items of this length."""
        at = self.lengths.index(length)
        w, i = [], []
        for block in range(4):
            key = (at * 4 + block) << 16 | (prints >> np.uint64(16 * block)).astype(np.int64) & 0xFFFF
            a, b = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
            n = b - a
            w.append(np.repeat(np.arange(len(prints)), n))
            i.append(self.owners[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        pair = np.unique(np.concatenate(w) * len(self.items) + np.concatenate(i))
        w, i = pair // len(self.items), pair % len(self.items)
        d = np.bitwise_count(prints[w] ^ self.prints[i]).astype(np.int64)
        ok = d <= self.radius
        return w[ok], i[ok], d[ok]

    def search(self, text: pa.Array):
        """Per match, the best window: (text, item, first word, words, distance, similarity)."""
        bare = Bare(text)
        begin, end = bare.offsets[:-1], bare.offsets[1:]
        for k in self.sizes:
            h = bare.shingles(k)
            known = self.known[k]
            at = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h)
            doc = np.searchsorted(bare.offsets, hit, "right") - 1
            inside = hit + k <= end[doc]
            hit, doc = hit[inside], doc[inside]
            lengths = [n for n in self.lengths if min(self.shingle, n) == k]
            if not len(hit):
                continue
            reach = max(lengths)
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (hit[1:] - hit[:-1] > 2 * reach)) + 1
            best: dict[tuple[int, int], tuple] = {}
            for part in np.split(hit, cuts):
                d = int(np.searchsorted(bare.offsets, part[0], "right") - 1)
                lo, hi = max(begin[d], part[0] - reach), min(end[d], part[-1] + reach + k)
                self._region(h, k, lengths, d, int(begin[d]), int(end[d]), int(lo), int(hi), part, best)
            for (d, i), (score, _, start, n, distance) in best.items():
                yield d, i, int(bare.place[start]), int(bare.place[start + n - 1] - bare.place[start] + 1), distance, score

    def _region(self, h, k, lengths, doc, begin, end, lo, hi, hits, best):
        """Windows of every length that hold one of ``hits`` (shingle positions), all inside lo .. hi."""
        bits = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(h[lo:hi - k + 1]), axis=0, dtype=np.int32)])
        for n in lengths:
            size = min(n, end - begin)                          # a text shorter than the item is one window
            mark = np.zeros(hi - lo + 2, np.int32)
            np.add.at(mark, np.maximum(hits - (size - k), begin) - lo, 1)
            np.add.at(mark, hits + 1 - lo, -1)
            p = np.flatnonzero(np.cumsum(mark) > 0) + lo
            p = p[p + size <= end]
            m = size - k + 1
            prints = simhash(bits[p - lo + m] - bits[p - lo], m)
            for w, i, distance in zip(*(x.tolist() for x in self.near(n, prints)), strict=True):
                start = int(p[w])
                score = weighted_jaccard(h[start:start + m], self.items[i][2])
                if score >= self.similarity and ((doc, i) not in best or (score, -start) > best[doc, i][:2]):
                    best[doc, i] = (score, -start, start, size, distance)


def load_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
               shingle: int = SHINGLE) -> tuple[DataFrame, list[list[str]], DataFrame]:
    """The distinct items of a benchmark, numbered into passes of bounded size.

    Items with the same words are one: ``members`` (id, key) says which ids a key stands for.  ``items`` (chunk, key, n, h)
    has each key once, and ``passes`` lists the chunks of each pass: ITEMS_PER_PASS items and SHINGLES_PER_PASS shingles
    at most (a longer item is a pass of its own).  Their number grows with the benchmark, so what a task holds does not.
    Items without words are left out.
    """
    ship(benchmark.sparkSession)
    most, longest = ITEMS_PER_PASS, SHINGLES_PER_PASS

    def hashed(batches):
        for b in batches:
            for i in range(b.num_rows):
                bare = Bare(b.column(1).slice(i, 1))
                n = len(bare.names)
                if n:
                    h = bare.shingles(min(shingle, n)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1), pa.array([f"{n}-{xxhash.xxh3_128_hexdigest(h.tobytes())}"]),
                         pa.array([n], pa.int64()), pa.array([h], pa.list_(pa.int64()))], ["id", "key", "n", "h"])

    def numbered(batches):
        part, chunk, count, total = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            names = []
            for size in pc.list_value_length(b.column("h")).to_pylist():
                if count and (count == most or total + size > longest):
                    chunk, count, total = chunk + 1, 0, 0
                count, total = count + 1, total + size
                names.append(f"{part}-{chunk}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *b.columns], ["chunk", "key", "n", "h"])

    rows = benchmark.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).mapInArrow(
        hashed, "id long, key string, n long, h array<long>")
    members = materialize(rows.select("id", "key").distinct(), "benchmark-members")
    items = materialize(rows.groupBy("key").agg(F.any_value("n").alias("n"), F.any_value("h").alias("h")).mapInArrow(
        numbered, "chunk string, key string, n long, h array<long>"), "benchmark-items")
    passes, count, total = [], 0, 0
    for r in items.groupBy("chunk").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("h")).alias("t")).orderBy("chunk").collect():
        if not passes or count + r["c"] > most or total + r["t"] > longest:
            passes.append([])
            count = total = 0
        passes[-1].append(r["chunk"])
        count, total = count + r["c"], total + r["t"]
    return members, passes, items


def _of_pass(items: DataFrame, chunks: list[str]) -> list[tuple[str, int, np.ndarray]]:
    """The items of one pass: key, number of words, shingle hashes."""
    return sorted(((r["key"], r["n"], np.array(r["h"], np.int64).view(np.uint64))
                   for r in items.where(F.col("chunk").isin(chunks)).collect()), key=lambda r: r[0])


class _Lazy:
    """An index that each Python worker builds once from the items."""

    def __init__(self, items, shingle, radius, similarity):
        self.args, self.key = (items, shingle, radius, similarity), uuid.uuid4().hex

    def get(self) -> Index:
        if self.key not in _BUILT:
            _BUILT.clear()
            _BUILT[self.key] = Index(*self.args)
        return _BUILT[self.key]


_BUILT: dict[str, Index] = {}


def _clean_udf(lazy: _Lazy):
    """A scalar Arrow UDF: whether a text matches no item."""
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            out = np.ones(len(text), bool)
            for at, n in slices(text):
                for found in lazy.get().search(text.slice(at, n)):
                    out[at + found[0]] = False
            yield pa.array(out)
            tidy()
        _BUILT.clear()             # a worker outlives its task
        tidy()
    return clean


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                 similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item that match: doc_id, item_id, first_word, n_words, distance, similarity.

    It gives the document's window of the greatest similarity (the first of equals) as a span of its
    white-space separated words.  Null and empty texts and items match nothing.  Rows that repeat an id
    give one row per item; rows with null ids are taken as one such document.  Empty tables give an empty
    result; other columns are ignored.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    schema = "doc_id long, key string, first_word long, n_words long, distance int, similarity double"
    members, passes, items = load_items(benchmark, item_col, item_text_col, shingle)
    if not passes:
        return docs.sparkSession.createDataFrame([], schema.replace("key string", "item_id long"))
    path = scratch_path(docs.sparkSession, "matches")
    for chunks in passes:                       # each pass is written before the next one's items are loaded
        lazy = _Lazy(_of_pass(items, chunks), shingle, radius, similarity)

        def scan(batches, lazy=lazy):
            index = lazy.get()
            for b in batches:
                for at, n in slices(b.column(1)):
                    got = list(index.search(b.column(1).slice(at, n)))
                    if got:
                        d, i, first, size, distance, score = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).slice(at, n).take(pa.array(d)), pa.array([index.items[x][0] for x in i], pa.string()),
                             pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(distance, pa.int32()),
                             pa.array(score, pa.float64())],
                            ["doc_id", "key", "first_word", "n_words", "distance", "similarity"])

        rows.mapInArrow(scan, schema).write.mode("append").parquet(path)
    found = docs.sparkSession.read.schema(schema).parquet(path).join(members.withColumnRenamed("id", "item_id"), "key")
    best = F.max_by(F.struct("first_word", "n_words", "distance", "similarity"),
                    F.struct("similarity", -F.col("first_word"), -F.col("distance")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                      similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that match no item, all columns as they are.

    Each pass writes the digests of the texts that match before the next one's items are loaded, and the rows with these
    texts go.  Texts stay where they are if Spark measures the digests small enough to send.
    """
    _, passes, items = load_items(benchmark, item_col, item_text_col, shingle)
    if not passes:
        return docs
    path, digest = scratch_path(docs.sparkSession, "contaminated"), fresh(docs.columns, "digest")
    texts = docs.select(col(text_col).alias("text"))
    for chunks in passes:
        clean = _clean_udf(_Lazy(_of_pass(items, chunks), shingle, radius, similarity))
        texts.where(~clean(F.col("text"))).select(F.sha2("text", 256).alias(digest)).write.mode("append").parquet(path)
    bad = docs.sparkSession.read.schema(f"{digest} string").parquet(path).distinct()
    return docs.withColumn(digest, F.sha2(col(text_col), 256)).join(bad, digest, "left_anti").select(*map(col, docs.columns))
