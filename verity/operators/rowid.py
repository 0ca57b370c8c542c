"""Row identity (7.3): ordered ids for "first row" semantics, dense positions for output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_
from ..session import scratch_path

_POS_BITS = 33  # monotonically_increasing_id = partition_id << 33 | position


def with_row_id(df: DataFrame, name: str = "_row_id", key: str | None = None) -> DataFrame:
    """Add a unique long id that follows input order.

    * ``key`` given: it must be unique and orders the rows.  An integer key is the id; of any other
      orderable key (text, dates, structs) the id is the rank.
    * rows of files (Parquet, CSV, JSON lines): the position over all files, in the order of
      (file, split, place in the split).
    * anything else (joins, in-memory rows): ids that follow the order of the partitions.  They hold as long
      as the input is not computed anew in another order, so give a key or a written table where that can happen.
    """
    if key is not None:
        kind = df.schema[key].dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return df.withColumn(name, col_(key).cast("long"))
        return dense_index(df, key, name)
    here = F.monotonically_increasing_id()
    try:
        known = df.select("_metadata").schema["_metadata"].dataType.names
    except AnalysisException:
        return df.withColumn(name, here)
    indexed = "row_index" in known
    rows = df.select("*", F.col("_metadata.file_path").alias("_vf"),
                     (F.col("_metadata.row_index") if indexed else here).alias("_vi"),
                     (F.lit(0).cast("long") if indexed else F.col("_metadata.file_block_start")).alias("_vb"))
    # one row per file or split: its first place, and how many rows come before it
    splits = rows.groupBy("_vf", "_vb").agg(F.count(F.lit(1)).alias("_vn"), F.min("_vi").alias("_vl"))
    before = Window.orderBy("_vf", "_vb").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("_vf").alias("_sf"), F.col("_vb").alias("_sb"),
                           (F.coalesce(F.sum("_vn").over(before), F.lit(0)) - F.col("_vl")).alias("_so"))
    return (rows.join(splits, (F.col("_vf") == F.col("_sf")) & (F.col("_vb") == F.col("_sb")))
            .withColumn(name, (F.col("_so") + F.col("_vi")).cast("long"))
            .drop("_vf", "_vi", "_vb", "_sf", "_sb", "_so"))


def dense_index(df: DataFrame, order_col: str | list, name: str = "_pos", partitions: int | None = None) -> DataFrame:
    """0-based contiguous position of each row when ordered by ``order_col`` (of a list: by the first, then the next ...).

    Range-partition on the key (one shuffle), sort inside partitions, and write that with each row's partition and place in it
    to the shared scratch folder, so that positions never change and nothing stays cached.  The partition's offset is added
    from an array literal with one number per partition, looked up by index.  No single-partition window.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mid = "_mid"
    by = [col_(c) for c in ([order_col] if isinstance(order_col, str) else order_col)]
    ranged = (df.repartitionByRange(n, *by).sortWithinPartitions(*by)
              .withColumn(mid, F.monotonically_increasing_id()))
    path = scratch_path(spark, "ranked")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    pid = F.shiftright(F.col(mid), _POS_BITS)
    counts = {r["p"]: int(r["n"]) for r in ranged.groupBy(pid.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offs, acc = [], 0
    for p in range(max(counts, default=-1) + 1):
        offs.append(acc)
        acc += counts.get(p, 0)
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offs or [0]]), (pid + 1).cast("int"))
    return ranged.withColumn(name, (off + F.col(mid).bitwiseAND((1 << _POS_BITS) - 1)).cast("long")).drop(mid)
