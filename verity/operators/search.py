"""Text search over a written table by trigram posting lists (V5).

The table is written in blocks of consecutive rows, and every trigram of a cell's lower-case text posts its block.  A query's rows lie in
the blocks that have all of its trigrams; only their files are read, and their rows are verified as a scan would.
A query of fewer than three letters has no trigram and scans all blocks.

Posting lists are dealt into folders by a hash of the trigram, sorted inside, so a search reads a few row groups of a few of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_
from .review import search_rows

GRAM = 3
LISTS = 64                    # folders of posting lists
BLOCK_ROWS = 100_000          # rows of one block
NAMED_BLOCKS = 10_000         # more blocks than that are joined, not named in the scan's filter


class SearchIndex:
    """A table and its posting lists in a shared folder."""

    def __init__(self, spark, path: str, row_id: str = "_row_id"):
        self.spark, self.path, self.row_id = spark, path.rstrip("/"), row_id

    def build(self, table: DataFrame, block_rows: int = BLOCK_ROWS) -> SearchIndex:
        """Write ``table`` in blocks by row id, and the posting lists of what was written.  The folder must be new."""
        blocks = max(1, -(-table.count() // block_rows))
        (table.repartitionByRange(blocks, col_(self.row_id)).sortWithinPartitions(col_(self.row_id))
         .withColumn("_block", F.spark_partition_id()).write.partitionBy("_block").parquet(f"{self.path}/rows"))
        rows = self._rows()
        # one pass over a cell's letters: taking each trigram by its place would walk there anew, the square of a text's length
        every = F.lit("(?s)(?=(.{%d}))" % GRAM)
        grams = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.lower(col_(c).cast("string")), F.lit("")), every, F.lit(1))
                                                     for c in rows.columns if c not in (self.row_id, "_block")])))
        posts = rows.select("_block", F.explode(grams).alias("gram")).distinct().withColumn("list", self._list(F.col("gram")))
        (posts.repartition("list").sortWithinPartitions("list", "gram", "_block").write.partitionBy("list").parquet(f"{self.path}/lists"))
        return self

    @staticmethod
    def _list(gram):
        return F.pmod(F.xxhash64(gram), F.lit(LISTS)).cast("int")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def candidates(self, query: str) -> DataFrame | None:
        """The blocks that have all trigrams of the query (None: it has none)."""
        q = query.lower()
        grams = sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})
        if not grams:
            return None
        keys = self.spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", self._list(F.col("gram")).alias("list")).collect()
        lists = self.spark.read.parquet(f"{self.path}/lists")
        mine = lists.where(F.col("list").isin([r["list"] for r in keys]) & F.col("gram").isin([r["gram"] for r in keys]))
        return mine.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("_block")

    def search(self, query: str) -> DataFrame:
        """The rows where any cell contains ``query`` (upper and lower case alike; an empty one keeps all): those of ``search_rows``."""
        rows, blocks = self._rows(), self.candidates(query)
        if blocks is not None:
            some = [r["_block"] for r in blocks.limit(NAMED_BLOCKS + 1).collect()]
            rows = rows.where(F.col("_block").isin(some)) if len(some) <= NAMED_BLOCKS else rows.join(blocks, "_block", "left_semi")
        return search_rows(rows.drop("_block"), query, self.row_id)
