"""Exact column statistics that stay bounded at any size: medians and modes.

The median is found by radix selection.  A double is turned into the integer that orders as
it does (its IEEE bits, negated below zero), and the integer's 16-bit digits are counted from the
top: four counting jobs, each for all columns together, end at the exact value.  A
job keeps at most 65,536 counts a column, whatever the number of rows, of distinct values or of ties.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .commits import Folder

DIGIT_BITS = 16
_NORMAL = 2.0 ** -1022      # the least normal double


def order_key(x: Column) -> Column:
    """A long that orders finite doubles as they order; -0.0 and 0.0 are both 0."""
    a = F.abs(x)
    e = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(a)).cast("int")))
    m = a / F.pow(F.lit(2.0), e.cast("double"))
    e = F.when(m >= 2, e + 1).when(m < 1, e - 1).otherwise(e)        # the logarithm may be off by a hair
    m = a / F.pow(F.lit(2.0), e.cast("double"))
    bits = F.when(a < _NORMAL, (a * 2.0 ** 537 * 2.0 ** 537).cast("long")).otherwise(
        F.shiftleft((e + 1023).cast("long"), 52) + ((m - 1) * 2.0 ** 52).cast("long"))
    return F.when(x == 0, F.lit(0).cast("long")).when(x < 0, -bits).otherwise(bits)


def _from_key(k: int) -> float:
    x = struct.unpack("<d", struct.pack("<q", abs(k)))[0]
    return -x if k < 0 else x


def exact_medians(df: DataFrame, columns: dict) -> dict:
    """Medians of several columns: {name: (double column, number of its non-null values)} to {name: median}.

    Values must be finite.  For an even number the two middle values are averaged; no value, no median.
    """
    columns = {c: (x, n) for c, (x, n) in columns.items() if n}
    if not columns:
        return {}
    names = list(columns)
    ranks = {i: sorted({(columns[c][1] - 1) // 2, columns[c][1] // 2}) for i, c in enumerate(names)}
    # worked out once, in steps of their own so that no value is looked at again and again, and written: the four jobs read integers
    doubles = df.select(*[columns[c][0].alias(f"_x{i}") for i, c in enumerate(names)])
    values = doubles.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"_x{i}").alias("x")) for i in range(len(names))]))
                            .alias("p")).select("p.k", "p.x").where(F.col("x").isNotNull())
    path = scratch_path(df.sparkSession, "medians")
    values.select("k", order_key(F.col("x")).alias("key")).write.parquet(path)
    values = df.sparkSession.read.schema("k int, key long").parquet(path)
    # of each (column, rank): the digits found so far, and the rank among the values that share them
    state = {(i, r): (None, r) for i, rs in ranks.items() for r in rs}
    for low in (48, 32, 16, 0):
        shared = {(i, prefix) for (i, _), (prefix, _) in state.items()}
        here = None
        for i, prefix in sorted(shared, key=str):
            hit = F.col("k") == i
            if prefix is not None:
                hit = hit & (F.shiftright("key", low + DIGIT_BITS) == prefix)
            here = hit if here is None else here | hit
        counts = values.where(here).groupBy("k", F.shiftright("key", low).alias("digits")).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("prefix", F.shiftright("digits", DIGIT_BITS) if low < 48 else F.lit(0).cast("long"))
        upto = Window.partitionBy("k", "prefix").orderBy("digits").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("to", F.sum("n").over(upto))
        wanted = None
        for (i, _), (prefix, r) in state.items():
            hit = (F.col("k") == i) & (F.col("to") > r) & (F.col("to") - F.col("n") <= r)
            if prefix is not None:
                hit = hit & (F.col("prefix") == prefix)
            wanted = hit if wanted is None else wanted | hit
        found = counts.where(wanted).collect()                    # one row for each rank at most
        state = {(i, rank): next((f["digits"], r - (f["to"] - f["n"])) for f in found if f["k"] == i
                                 and (prefix is None or f["prefix"] == prefix) and f["to"] - f["n"] <= r < f["to"])
                 for (i, rank), (prefix, r) in state.items()}
    out = {}
    for i, c in enumerate(names):
        v = [_from_key(state[i, r][0]) for r in ranks[i]]
        out[c] = (v[0] + v[-1]) / 2.0
    Folder(df.sparkSession, path).remove()
    return out


def modes(df: DataFrame, columns: list) -> dict:
    """Most frequent non-null value per column (ties: smallest value) and its count.

    One shuffle for all columns: unpivot to (column, value), count per pair with
    map-side partial aggregation, then pick per column.
    """
    from ..functions.text import col_
    if not columns:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("k"), col_(c).cast("string").alias("v")) for c in columns])).alias("p"))
    counts = (pairs.where(F.col("p.v").isNotNull())
              .groupBy(F.col("p.k").alias("k"), F.col("p.v").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("k").agg(F.min_by(F.struct("v", "n"), F.struct((-F.col("n")).alias("nn"), "v"))
                                   .alias("b")).collect()
    return {r["k"]: (r["b"]["v"], int(r["b"]["n"])) for r in best}
