"""Helpers shared by the operators: written tables, word splitting, rolling hashes, components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

BATCH_BYTES = 8 << 20   # what Spark hands to a Python worker at a time
SLICE_BYTES = 4 << 20   # text that one vectorised step holds at a time


def ship(spark: SparkSession) -> None:
    """Make a session ready for operators with Python workers.

    Arrow batches are bounded by bytes, as texts can be long, and this package is sent to the
    workers (once per context), so that a cluster needs no installation.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_verity_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="verity-"), "verity.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    sc.addPyFile(path)          # Spark's own file service hands it to the executors
    sc._verity_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns, name: str) -> str:
    """``name``, or a variant that no column of ``columns`` has (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str):
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def loose(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its long ``keys`` as new columns.

    An aggregate lies by its keys already, so a join on them would not shuffle it again, and AQE splits the hot keys
    of a join only where both sides come straight from shuffles of the join.  With new columns they do.
    """
    return df.select(*[F.col(c).bitwiseXOR(F.lit(0).cast("long")).alias(c) if c in keys else col(c) for c in df.columns])


# ---------------------------------------------------------------- words

def tidy() -> None:
    """Give freed memory back to the system: a Python worker outlives its stage, and executors are small."""
    for r in Rolling.all:
        r.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def parts_of(text: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, length) runs of rows holding about ``max_bytes`` of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    at = 0
    ends = np.cumsum(sizes, dtype=np.int64)
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield at, to - at
        at = to


def slices(text: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """``parts_of`` a batch, after which freed memory is handed back."""
    yield from parts_of(text, max_bytes)
    tidy()


class Words:
    """The ASCII-whitespace separated words of some texts, dictionary-coded.

    ``codes[offsets[i]:offsets[i + 1]]`` are text i's words as positions in ``values``.
    A null text has no words.
    """

    def __init__(self, text: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.string()), ""))
        flat = lists.flatten()
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        full = pc.not_equal(flat, "")          # splitting leaves empty strings at the edges
        seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
        self.offsets = seen[at]
        coded = flat.filter(full).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = coded.dictionary

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def starts(self) -> np.ndarray:
        """For each word, the position of the first word of its text."""
        return np.repeat(self.offsets[:-1], np.diff(self.offsets))


# white space of any kind, as RE2 and Python name it, and sentencepiece's sign for it: no text is cut beside them
_SPACES = r"\x{2581}\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSAFE = f"[ {_SPACES}] | [{_SPACES}]|^ | $"     # a space beside white space or an edge
LONE_SPACE = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")


class Pieces:
    """Texts cut at the spaces that stand alone between other characters, dictionary-coded.

    ``codes[offsets[i]:offsets[i + 1]]`` are text i's pieces as positions in ``values``; joined by one space they are the text.
    Every text has a piece; that of an empty or null one is empty.
    """

    def __init__(self, text: pa.Array):
        text = pc.fill_null(text.cast(pa.string()), "")
        lists = pc.split_pattern(text, " ")
        odd = np.flatnonzero(pc.match_substring_regex(text, _UNSAFE).to_numpy(zero_copy_only=False))
        if len(odd):
            own = pa.array([LONE_SPACE.split(text[i].as_py()) for i in odd.tolist()], lists.type)
            order = np.arange(len(text))
            order[odd] = len(text) + np.arange(len(odd))
            lists = pa.concat_arrays([lists, own]).take(pa.array(order))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of several runs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.repeat(starts - shift, lengths) + np.arange(total, dtype=np.int64)


# ---------------------------------------------------------------- hashes

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Polynomial hashes mod 2**64 of any span of a sequence of 64-bit names, by prefix sums."""

    all: list[Rolling] = []

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.forget()
        Rolling.all.append(self)

    def forget(self) -> None:
        """Give up the tables of powers."""
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(max(n, 1 << 16), b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, names: np.ndarray) -> np.ndarray:
        self._powers(len(names) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * self.up[:len(names)], dtype=np.uint64)])

    def span(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((prefix[hi] - prefix[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


# ---------------------------------------------------------------- connected components

def _local_forest(batches):
    """Replace one partition's links by links from each node to the smallest of its local component."""
    up: dict[int, int] = {}

    def root(x):
        r = x
        while up.get(r, r) != r:
            r = up[r]
        while up.get(x, x) != r:
            up[x], x = r, up[x]
        return r

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in up]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i:i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()),
                                          pa.array([p[1] for p in part], pa.int64())], ["u", "v"])


def connected_components(links: DataFrame) -> DataFrame:
    """Components of an undirected graph given as two long columns: rows (node, root), root the smallest node.

    Each round is a large-star then a small-star step (both joins and aggregates, so a
    node with very many links is pre-aggregated and AQE may split its join); rounds end when
    the links no longer change.  Each partition's links are first reduced to its own
    forest.  Every round's links are a written table.  Nodes without links are not returned.
    """
    a, b = links.columns
    e = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
         .mapInArrow(_local_forest, "u long, v long").where("u <> v").distinct())
    e = materialize(e, "links")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(loose(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(loose(low, "u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, "links")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
