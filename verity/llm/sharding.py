"""Sharding by jump consistent hashing (operator 9, native expressions only).

A row's shard is a function of its key and the number of shards.  The jump walk draws one
pseudo-random number per step from the key; the row sits in the last bucket that the walk
visits before it leaves the range.  When a shard is appended, a walk either stays where it
was or jumps into the new one, so only about 1 / (n + 1) of the rows move, all into it.
No ring table exists.

The walk's numbers come from the published generator key * 2862933555777941757 + 1 (mod
2**64).  It is worked out in 16-bit and 32-bit limbs, as a plain product would overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, materialize

MULTIPLIER = 2862933555777941757


def _next(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, on a signed long, without overflow."""
    a = [MULTIPLIER >> 16 * i & 0xFFFF for i in range(4)]
    k = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    total, limbs = F.lit(1).cast("long"), []
    for i in range(4):
        for j in range(i + 1):
            total = total + k[j] * F.lit(a[i - j]).cast("long")
        limbs.append(total.bitwiseAND(F.lit(0xFFFF)))
        total = F.shiftrightunsigned(total, 16)
    out = limbs[0]
    for i in range(1, 4):
        out = out.bitwiseOR(F.shiftleft(limbs[i], 16 * i))
    return out


def _walk(state: Column, steps: Column, shards: int) -> Column:
    """Steps of the jump walk on (key, bucket, next bucket) structs; a walk that left the range stays."""
    def step(s, _):
        on = s["jump"] < F.lit(shards)
        key = _next(s["key"])
        u = F.shiftrightunsigned(key, 33) + F.lit(1).cast("long")
        ahead = F.floor((s["jump"] + 1).cast("double") * (F.lit(float(1 << 31)) / u.cast("double")))
        return F.when(on, F.struct(key.alias("key"), s["jump"].alias("bucket"), ahead.alias("jump"))).otherwise(s)
    return F.aggregate(steps, state, step)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard 0 .. shards - 1 of a long key (null: as zero)."""
    if shards < 1:
        raise ValueError("at least one shard")
    start = F.struct(F.coalesce(key, F.lit(0)).cast("long").alias("key"), F.lit(-1).cast("long").alias("bucket"),
                     F.lit(0).cast("long").alias("jump"))
    first = min(shards, 64)          # a walk takes about ln(shards) steps; one that takes more goes on
    s = _walk(start, F.sequence(F.lit(1), F.lit(first)), shards)
    if shards > first:
        s = F.when(s["jump"] < shards, _walk(s, F.sequence(F.lit(first + 1), F.lit(shards)), shards)).otherwise(s)
    return s["bucket"].cast("int")


def assign(df: DataFrame, key: Column, shards: int) -> DataFrame:
    """``df`` with the columns shard, slot and grown_shard.

    ``slot`` numbers each shard's rows from 0 without gaps, in the order of the key (null first; equal keys in any order).  Rows are
    sorted over all tasks by (shard, key, a random number), so neither a large shard nor a repeated row is one task's, and written
    with their places, so that numbers never change; a row's slot is its place plus its shard's rows in the partitions before.
    """
    names = df.columns
    mid, salt, pid, n, first, at = (fresh([*names, "shard", "slot", "grown_shard"], x) for x in ("mid", "salt", "pid", "rows", "least", "offset"))
    order = fresh([*names, "shard", "slot", "grown_shard"], "key")
    rows = df.select("*", jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"),
                     key.alias(order), F.rand(11).alias(salt))
    by = [F.col("shard"), F.col(order).asc_nulls_first(), F.col(salt)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(mid, F.monotonically_increasing_id()),
                       "sharded").withColumn(pid, F.shiftright(mid, 33))
    before = Window.partitionBy("shard").orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", pid).agg(F.count(F.lit(1)).alias(n), F.min(mid).alias(first))     # a row a shard and partition
    offsets = counts.select("shard", pid, (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).alias(at))
    return rows.join(offsets, ["shard", pid]).select(*[col(c) for c in names], "shard", (F.col(at) + F.col(mid)).alias("slot"), "grown_shard")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text counts as empty (size 1, checksum 0); a null id shards as zero.  Rows with equal ids are in one shard, and repeated rows
    have slots of their own.  Slots follow the ids; which of the rows of one id has which of its slots differs between runs.  An empty table gives an empty result; other columns are ignored.
    """
    text = col(text_col)
    rows = docs.select(col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    return assign(rows, F.col("doc_id"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, key: Column, shards: int, out: str) -> None:
    """Write ``df`` to folders shard=0, shard=1, ... in ``out``; each shard is spread over many files."""
    df.withColumn("shard", jump_shard(key, shards)).write.partitionBy("shard").parquet(out)
