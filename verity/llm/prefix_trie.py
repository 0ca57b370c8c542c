"""Prefix trie of conversations by vertical bitmaps (operator 13).

Conversations are rebuilt first: all but every fifth begin with the first turns of the fifth one before them.  A node of the
trie is a distinct sequence of first turns; its members are the conversations that begin with it.

A shard is a run of SHARD conversations in ascending order of their ids.  It is indexed by vertical bitmaps: for every
(position, turn) the bitset of the conversations with that turn there, and for every position those that end there.  From the root down,
a node's bitset is intersected with the posting of a turn that a remaining member has next: that is the
child's bitset, its popcount the number of members, its lowest bit the smallest id.  Intersected with the
posting of the ends it is the node's end list.  Bitsets are integers, and every intersection finds a child.

Shards do not share a dictionary: a turn's name is 128 bits of hash of role and text, and a node's name is a polynomial in the
names of its turns, so the shards' counts of a node are summed by its name.  End lists are hashed in the order of the shards,
as a stream.  Sums over subtrees take a number of rounds that is the logarithm of the depth: each node's sum over the nodes less than
2**k below it, and its 2**k-th ancestor, give those for k + 1.  Only nodes with several members go into the rounds.

A conversation may be as long as the table.  Its turns are numbered by a sort that cuts it wherever it likes, with the
counts before each cut (a row for each partition) added afterwards, and it goes into the bitmaps in layers of LAYER positions, each
from the name of the node that the layers before it lead to.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, loose, materialize, ship

GROUP, HEADS = 5, 9            # conversations that share a beginning, and one more than the turns of it that they can take
LAYER = 64                     # positions of one layer
SHARD = 4096                   # conversations (layers of them) in one shard
FULL = (1 << 64) - 1
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_NO_END = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- positions

def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _places(batches):
    """Sorted rows (conv, a, b, n) with the partition and each row's place in its conversation within the partition."""
    pid, last, carry = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        start = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        sizes = np.diff(np.append(start, len(conv)))
        place = np.arange(len(conv)) - np.repeat(start, sizes)
        if conv[0] == last:
            place[:sizes[0]] += carry
        last, carry = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), pid, np.int64)), pa.array(place)],
                                         ["conv", "a", "b", "n", "pid", "place"])


def _cut(df: DataFrame, total) -> list[tuple[int, int, object]]:
    """(pid, conv, total) of the conversations that lie in several partitions: a row or two for each partition."""
    ends = df.groupBy("pid").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi")).collect()
    seen: dict[int, int] = {}
    for r in ends:
        for c in {r["lo"], r["hi"]}:
            seen[c] = seen.get(c, 0) + 1
    parted = [c for c, n in seen.items() if n > 1]
    if not parted:
        return []
    return [tuple(r) for r in df.where(F.col("conv").isin(parted)).groupBy("pid", "conv").agg(total).collect()]


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, pos, a, b, n): the turns' positions from 0 in the order of (turn, a, b), nulls first."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    placed = materialize(rows.repartitionByRange(_partitions(rows), *order).sortWithinPartitions(*order)
                         .select("conv", "a", "b", "n").mapInArrow(
                             _places, "conv long, a long, b long, n long, pid long, place long"), "places")
    before, shifts = {}, []
    for pid, conv, n in sorted(_cut(placed, F.count(F.lit(1)))):
        shifts.append((pid, conv, before.get(conv, 0)))
        before[conv] = before.get(conv, 0) + n
    table = rows.sparkSession.createDataFrame(shifts, "pid long, conv long, shift long")      # bounded by the partitions
    return placed.join(F.broadcast(table), ["pid", "conv"], "left").select(
        "conv", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("pos"), "a", "b", "n")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Of numbered turns, those of the rebuilt conversations, and one row with n = -1 where each of them ends."""
    own = F.pmod("conv", F.lit(GROUP)) == 0
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("long")
    heads = turns.where(own & (F.col("pos") < HEADS - 1)).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "n"))).alias("head")).withColumnRenamed("conv", "first")
    info = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size")).withColumn("first", F.col("conv") - F.pmod("conv", F.lit(GROUP)))
    none = F.array().cast("array<struct<pos:long,a:long,b:long,n:long>>")
    taken = F.when(own, none).otherwise(F.coalesce(F.slice("head", F.lit(1), h.cast("int")), none))
    info = info.join(heads, "first", "left").select("conv", "size", taken.alias("taken"), F.when(own, 0).otherwise(h).alias("h"))
    info = materialize(info.select("conv", "taken", (F.size("taken") - F.col("h")).alias("shift"), (
        F.size("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "beginnings")
    taken = info.select("conv", F.explode("taken").alias("t")).select("conv", "t.pos", "t.a", "t.b", "t.n")
    ends = info.select("conv", F.col("length").cast("long").alias("pos"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
                       F.lit(-1).cast("long").alias("n"))
    rest = turns.where(own | (F.col("pos") >= h)).join(
        loose(info.where("shift <> 0").select("conv", "shift"), "conv"), "conv", "left").select(
            "conv", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "a", "b", "n")
    return taken.unionByName(rest).unionByName(ends)


# ---------------------------------------------------------------- bitmaps

@lru_cache(4)
def _powers(layer: int, height: int) -> tuple[list[int], list[int]]:
    """The bases' powers at the positions of one layer."""
    out = []
    for base in _BASE:
        p, row = pow(base, layer * height, 1 << 64), []
        for _ in range(height):
            row.append(p)
            p = p * base & FULL
        out.append(row)
    return out[0], out[1]


def _starts(height: int):
    """Sorted layers (conv, layer, a, b, n) with their place, and the name before and after each, as of the partition's first layer."""
    def run(batches):
        pid, last, s1, s2, place = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            rows = []
            for conv, layer, a, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    last, s1, s2 = conv, 0, 0
                p1, p2 = _powers(layer, height)
                turns = len(n) - (n[-1] < 0)
                e1 = (s1 + sum(x * p for x, p in zip(a[:turns], p1, strict=False))) & FULL
                e2 = (s2 + sum(x * p for x, p in zip(b[:turns], p2, strict=False))) & FULL
                rows.append((s1, s2, e1, e2))
                s1, s2 = e1, e2
            names = np.array(rows, np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(names), pid, np.int64)), pa.array(place + np.arange(len(names))),
                 *(pa.array(names[:, i].copy()) for i in range(4))],
                ["conv", "layer", "a", "b", "n", "pid", "place", "s1", "s2", "e1", "e2"])
            place += len(names)
    return run


class Shard:
    """Layers of conversations in ascending order, indexed by vertical bitmaps."""

    def __init__(self, units: list[tuple], height: int = LAYER):
        """``units``: (conv, layer, names before, [(a, b)], [bytes], whether it ends here)."""
        self.units, self.height = units, height
        self.roots: dict[tuple, int] = {}
        self.postings: dict[tuple, int] = {}
        self.ends: dict[int, int] = {}
        for i, (_, layer, start, turns, _, ended) in enumerate(units):
            bit, at = 1 << i, layer * height
            self.roots[layer, start] = self.roots.get((layer, start), 0) | bit
            for p, turn in enumerate(turns, at):
                self.postings[p, turn] = self.postings.get((p, turn), 0) | bit
            if ended:
                self.ends[at + len(turns)] = self.ends.get(at + len(turns), 0) | bit

    def _convs(self, bits: int):
        while bits:
            low = bits & -bits
            yield self.units[low.bit_length() - 1][0]
            bits ^= low

    def walk(self):
        """Depth first: nodes (name, parent's name, depth, members, least conv, bytes, None), and ends (name, ..., least conv, ids)."""
        units, postings = self.units, self.postings
        for (layer, start), bits in self.roots.items():
            base = layer * self.height
            p1, p2 = _powers(layer, self.height)
            if not layer:
                yield (*start, None, None, 0, bits.bit_count(), units[(bits & -bits).bit_length() - 1][0], 0, None)
            todo = [(base, bits, *start)]
            while todo:
                depth, bits, k1, k2 = todo.pop()
                if ended := bits & self.ends.get(depth, 0):
                    ids = list(self._convs(ended))
                    yield k1, k2, None, None, depth, None, ids[0], None, ",".join(map(str, ids))
                    bits ^= ended
                at = depth - base
                if at == self.height:                    # the members that are left go on in the next layer
                    continue
                while bits:
                    i = (bits & -bits).bit_length() - 1
                    conv, _, _, turns, sizes, _ = units[i]
                    turn = turns[at]
                    child = bits & postings[depth, turn]
                    bits ^= child
                    c1, c2 = (k1 + turn[0] * p1[at]) & FULL, (k2 + turn[1] * p2[at]) & FULL
                    yield c1, c2, k1, k2, depth + 1, child.bit_count(), conv, sizes[at], None
                    todo.append((depth + 1, child, c1, c2))


_WALK = "k1 long, k2 long, p1 long, p2 long, depth long, n long, conv long, bytes long, ends string"


def _signed(x: int | None) -> int | None:
    return x if x is None or x < 1 << 63 else x - (1 << 64)


def _walk_rows(shard: Shard):
    rows = []

    def batch():
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [*(pa.array([_signed(x) for x in c], pa.int64()) for c in cols[:4]), *(pa.array(c, pa.int64()) for c in cols[4:8]),
             pa.array(cols[8], pa.string())], [f.split()[0] for f in _WALK.split(", ")])

    for r in shard.walk():
        rows.append(r)
        if len(rows) == 20_000:
            yield batch()
            rows = []
    if rows:
        yield batch()


def _bitmaps(size: int, height: int):
    """Shards of the layers as they come: a new one begins after ``size`` layers, or where a layer is not the next one of the order.

    So shards do not overlap, however the files of the sorted table are dealt to tasks.
    """
    def run(batches):
        units, last = [], None
        for batch in batches:
            for conv, layer, a, b, n, pid, place, s1, s2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(units) == size or (units and (pid, place - 1) != last):
                    yield from _walk_rows(Shard(units, height))
                    units = []
                last, ended = (pid, place), n[-1] < 0
                turns = [(x & FULL, y & FULL) for x, y in zip(a, b, strict=True)]
                units.append((conv, layer, (s1 & FULL, s2 & FULL), turns[:-1] if ended else turns, n, ended))
        if units:
            yield from _walk_rows(Shard(units, height))
    return run


def _hash_ends(batches):
    """Sorted rows (k1, k2, first conv, ids) to one SHA-256 for each node, as a stream."""
    now, digest, out = None, None, []

    def rows():
        k = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(k[0], pa.int64()), pa.array(k[1], pa.int64()), pa.array(k[2], pa.string())], ["k1", "k2", "sha"])

    for batch in batches:
        for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if (k1, k2) != now:
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_buffer())
        if len(out) >= 20_000:
            yield rows()
            out = []
    if now:
        out.append((*now, digest.hexdigest()))
    if out:
        yield rows()


# ---------------------------------------------------------------- trie

def subtree_sums(nodes: DataFrame) -> DataFrame:
    """Of (k1, k2, a1, a2 (the parent, null for a root), leaves, saved): the last two summed over each node's subtree.

    After round k a row has the sums over what is less than 2**k below it, and its 2**k-th ancestor.
    """
    while not nodes.where("a1 is not null").isEmpty():
        below = nodes.where("a1 is not null").groupBy("a1", "a2").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = nodes.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        up = nodes.join(loose(above, "a1", "a2"), ["a1", "a2"], "left").select("k1", "k2", "b1", "b2", "leaves", "saved")
        nodes = materialize(loose(up, "k1", "k2").join(
            loose(below.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), "l", "s"), "k1", "k2"), ["k1", "k2"], "left").select(
                "k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "subtrees")
    return nodes.select("k1", "k2", "leaves", "saved")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", shard: int = SHARD, layer: int = LAYER) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty.  Rows without a conversation's id belong to none and are left out.  Turns of one conversation that
    tie (and rows that repeat one) all count, in the order of a hash of role and text.  The first conversation of five is that of the
    next multiple of five at or below the id.  Two sequences are equal if 128 bits of hash are.  An empty table gives an empty
    result; other columns are ignored.
    """
    ship(conversations.sparkSession)
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(col(conv_col).isNotNull()).select(
        col(conv_col).cast("long").alias("conv"), col(turn_col).alias("turn"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("n"))
    turns = rebuilt(numbered(rows)).withColumn("layer", F.floor(F.col("pos") / layer).cast("long"))
    layers = turns.groupBy("conv", "layer").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "n"))).alias("s")) \
        .select("conv", "layer", "s.a", "s.b", "s.n")                    # ``layer`` turns at most
    layers = materialize(layers.repartitionByRange(_partitions(rows), "conv", "layer").sortWithinPartitions("conv", "layer").mapInArrow(
        _starts(layer), "conv long, layer long, a array<long>, b array<long>, n array<long>, pid long, place long, s1 long, s2 long, e1 long, e2 long"), "layers")
    before, shifts = {}, []
    for pid, conv, end in sorted(_cut(layers, F.max_by(F.struct("e1", "e2"), "layer"))):
        o = before.get(conv, (0, 0))
        shifts.append((pid, conv, *map(_signed, o)))
        before[conv] = ((o[0] + end[0]) & FULL, (o[1] + end[1]) & FULL)
    table = rows.sparkSession.createDataFrame(shifts, "pid long, conv long, o1 long, o2 long")     # bounded by the partitions

    def placed_at(batches):
        for batch in batches:
            s = [batch.column(i).to_numpy().view(np.uint64) + batch.column(i + 2).to_numpy().view(np.uint64) for i in (7, 8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *(pa.array(x.view(np.int64)) for x in s)],
                                             ["conv", "layer", "a", "b", "n", "pid", "place", "s1", "s2"])

    zero = F.lit(0).cast("long")
    placed = layers.join(F.broadcast(table), ["pid", "conv"], "left").select(
        "conv", "layer", "a", "b", "n", "pid", "place", "s1", "s2", F.coalesce("o1", zero).alias("o1"), F.coalesce("o2", zero).alias("o2"))
    found = materialize(placed.mapInArrow(
        lambda batches: _bitmaps(shard, layer)(placed_at(batches)), _WALK), "walks")
    nodes = materialize(found.where("n is not null").groupBy("k1", "k2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
        F.max("bytes").alias("bytes")), "nodes")
    ends = found.where("n is null").select("k1", "k2", "conv", "ends").repartition(_partitions(rows), "k1", "k2") \
        .sortWithinPartitions("k1", "k2", "conv").mapInArrow(_hash_ends, "k1 long, k2 long, sha string")
    below = nodes.where("p1 is not null").groupBy("p1", "p2").agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n") == 1).alias("single")).withColumnsRenamed({"p1": "k1", "p2": "k2"})
    nodes = materialize(nodes.join(loose(below, "k1", "k2"), ["k1", "k2"], "left").fillna(0, ["n_children", "single"]), "nodes")
    # a node of one member has one leaf and saves nothing
    shared = nodes.where("n > 1").select(
        "k1", "k2", F.col("p1").alias("a1"), F.col("p2").alias("a2"),
        (F.col("single") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    sums = subtree_sums(materialize(shared, "subtrees"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(loose(parents, "p1", "p2"), ["p1", "p2"], "left")
    out = loose(out, "k1", "k2").join(loose(sums, "k1", "k2"), ["k1", "k2"], "left").join(loose(ends, "k1", "k2"), ["k1", "k2"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
                      F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
                      F.coalesce("sha", F.lit(_NO_END)).alias("ends_sha256"))
