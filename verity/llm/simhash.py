"""SimHash near-dedup with covering locality-sensitive hashing (operator 1).

A fingerprint is 64 bits: bit j is set when it is set in over half of the hashes of the
text's word shingles.  Two fingerprints link when they differ in at most ``radius`` bits.

Candidates come from structured bit masks.  Each bit position gets a non-zero code of
``radius + 1`` bits, and table v (for every non-zero v) hashes the positions whose code
has an odd inner product with v.  The codes of at most ``radius`` differing positions span
less than the whole space, so some v is orthogonal to all of them: that table sees none of
the differences, and the pair collides there.  With radius 4 there are 31 tables that each
keep about half of the bits.

A bucket may be large (many near copies).  Its pairs are not listed: within a bucket only
the links of a spanning forest are returned.  A bucket of over ``BUCKET`` fingerprints is
passed on to the next round, where the same construction on its free bits splits it into
smaller buckets; since fingerprints are distinct, a bucket with f free bits has at most
2**f of them, so a few rounds end it, and no pair within the radius is lost.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, connected_components, fresh, loose, materialize, ship, tidy

SHINGLE, RADIUS = 4, 4
SEED = 42
BUCKET = 4096           # fingerprints that one bucket may hold before it is split further
SMALL = 8               # buckets up to this size are compared by shifting the sorted array
TEXT_STEP = 1 << 20     # bytes of one text that are held as words at a time
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes):
    """The words of a text, in lists over about TEXT_STEP bytes each."""
    at = 0
    while len(text) - at > TEXT_STEP:
        cut = _SPACE.search(text, at + TEXT_STEP)
        if cut is None:
            break
        yield text[at:cut.start()].split()
        at = cut.end()
    yield text[at:].split()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text (null: as an empty one, zero)."""
    carry, ones, total, words_seen = [], np.zeros(64, np.int64), 0, 0
    for words in _pieces((text or b"").lower()):
        words_seen += len(words)
        words = carry + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            first = (end - size)[:len(words) - shingle + 1].tolist()
            h = np.fromiter((xxhash.xxh64_intdigest(joined[a:z], SEED)
                             for a, z in zip(first, end[shingle - 1:].tolist(), strict=True)), np.uint64, len(first))
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
                .sum(axis=0, dtype=np.int64)
            total += len(first)
        carry = words[max(0, len(words) - shingle + 1):] if shingle > 1 else []
    if not words_seen:
        return 0
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return sum(1 << j for j in np.flatnonzero(2 * ones > total).tolist())


def fingerprint_udf(shingle: int = SHINGLE):
    """A scalar Arrow UDF: text (as binary) to its fingerprint as a signed long."""
    @F.arrow_udf("long")
    def simhash(text: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(t.as_py(), shingle) for t in text), np.uint64, len(text))
        tidy()
        return pa.array(out.view(np.int64))
    return simhash


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """Masks over ``positions`` such that any ``radius`` of them are all left out by some mask."""
    top = 1 << (radius + 1)
    code = {p: 1 + i % (top - 1) for i, p in enumerate(positions)}
    return [sum(1 << p for p, c in code.items() if (c & v).bit_count() & 1) for v in range(1, top)]


def forest(u: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the distinct fingerprints ``u`` under distance <= radius."""
    left, right, rest = [], [], u
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                hit, rest = rest[near], rest[~near]
                left.append(np.full(len(hit), x))
                right.append(hit)
                todo.extend(hit)
    return (np.concatenate(left), np.concatenate(right)) if left else (u[:0], u[:0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(radius: int, limit: int):
    """Partition step over rows (mask, key, fp) sorted by them: links, and the rows of buckets over ``limit``.

    Output rows (mask, a, b): a link when mask is null, else fingerprint ``a`` of a bucket to split.
    """
    def rows(mask, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(mask, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["mask", "a", "b"])

    def links(a, b):
        return rows([None] * len(a), a, b)

    def splits(m):
        return 64 - (int(m) & (2**64 - 1)).bit_count() > 2 * (radius + 1)

    def closed(m, u, start, size):
        """Buckets that are complete and not over the limit, given by their starts and sizes."""
        for k in range(1, min(SMALL, int(size.max(initial=0)))):
            i = start[(size <= SMALL) & (size > k)]
            n = size[(size <= SMALL) & (size > k)] - k
            if len(i):
                i = np.repeat(i - (np.cumsum(n) - n), n) + np.arange(n.sum())
                near = np.bitwise_count(u[i] ^ u[i + k]) <= radius
                if near.any():
                    yield links(u[i[near]], u[i[near] + k])
        for i, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            a, b = forest(u[i:i + n], radius)
            if len(a):
                yield links(a, b)

    def run(batches):
        held = None          # the last bucket of what was read, whose rest may follow
        spilling = None      # (mask, key) of a bucket over the limit that is being passed on
        for batch in batches:
            m, k, u = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            u = u.view(np.uint64)
            if held is not None:
                m, k, u = (np.concatenate(x) for x in zip(held, (m, k, u), strict=True))
            if not len(u):
                continue
            start = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (k[1:] != k[:-1])]))
            size = np.diff(np.append(start, len(u)))
            over = np.zeros(len(start), bool)
            if spilling is not None:
                over[0] = (m[0], k[0]) == spilling
            for i in np.flatnonzero(size > limit).tolist():
                over[i] = over[i] or splits(m[start[i]])
            for i in np.flatnonzero(over).tolist():
                part = u[start[i]:start[i] + size[i]]
                yield rows(np.full(len(part), m[start[i]]), part, part)
            last = len(start) - 1
            spilling = (m[-1], k[-1]) if over[last] else None
            held = None if over[last] else (m[start[last]:], k[start[last]:], u[start[last]:])
            done = ~over
            done[last] = False
            yield from closed(m, u, start[done], size[done])
        if held is not None:
            u = held[2]
            yield from closed(held[0], u, np.zeros(1, np.int64), np.array([len(u)]))
    return run


def near_links(prints: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (column ``fp``) within ``radius`` bits.

    Every pair within the radius is connected by the links; within a bucket only a spanning forest is returned.
    """
    base = [_signed(x) for x in covering_masks(radius, list(range(64)))]
    rows = prints.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in base])).alias("mask"))
    found = None
    while True:
        keyed = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = materialize(keyed.repartition(n, "mask", "key").sortWithinPartitions("mask", "key", "fp")
                          .mapInArrow(_bucket_links(radius, limit), "mask long, a long, b long"), "simhash")
        links = out.where("mask is null").select("a", "b")
        found = links if found is None else found.unionByName(links)
        hot = out.where("mask is not null").select("mask", F.col("a").alias("fp"))
        masks = [r[0] for r in hot.select("mask").distinct().collect()]   # at most 31 at first, 31 * 31 next
        if not masks:
            return found
        finer = []
        for m in masks:
            free = [p for p in range(64) if not (m & (2**64 - 1)) >> p & 1]
            finer.append((m, [_signed((m & (2**64 - 1)) | x) for x in covering_masks(radius, free)]))
        table = prints.sparkSession.createDataFrame(finer, "mask long, finer array<long>")
        rows = (hot.join(F.broadcast(table), "mask").select("fp", F.explode("finer").alias("mask")).distinct())


def _grouped(rows: DataFrame, text: str, shingle: int, radius: int) -> DataFrame:
    """``rows`` (doc_id, the text column, others) with the text replaced by fp, root (of the group) and component_id."""
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c != text]
    prints = materialize(rows.select(*names, fingerprint_udf(shingle)(F.col(text).cast("binary")).alias("fp")), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(known.select("fp", "root").join(loose(named, "root"), "root").select("fp", "root", "component_id"), "fp") \
        .select(*names, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row per input row: (doc_id, fp long, component_id).

    Null texts count as empty; texts without words have fingerprint zero and link like any other.
    A row whose id is null still belongs to a component, but never names it: component_id is the
    smallest non-null id that is reachable (null if there is none).  Repeated rows are repeated.
    An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return _grouped(rows, "text", shingle, radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """One row of each component, all columns kept: that of the smallest id (null ids last), then of a hash of the text.

    A row is known by its id and its text, so rows that share an id but not a component are judged apart; of rows that
    repeat both, the one with the least hash of all its columns stays.  Null texts count as empty ones.
    """
    h, doc, order, n = (fresh(docs.columns, x) for x in ("h", "doc", "order", "n"))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("h"))
    first = _grouped(rows, "text", shingle, radius).groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h", "n")).alias("r"))
    first = materialize(first.select(F.col("r.doc_id").alias(doc), F.col("r.h").alias(h), F.col("r.n").alias(n)), "first")
    kept = docs.join(first, col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(col(text_col)) == F.col(h)))
    every = F.xxhash64(*[col(c).cast("string") if t.startswith(("map", "variant")) else col(c) for c, t in docs.dtypes])
    w = Window.partitionBy(doc, h).orderBy(every)
    again = kept.where(F.col(n) > 1).withColumn(order, F.row_number().over(w)).where(F.col(order) == 1)    # only these are compared
    names = [col(c) for c in docs.columns]
    return kept.where(F.col(n) == 1).select(*names).unionByName(again.select(*names))


def hex_digits(fp):
    """A signed long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
