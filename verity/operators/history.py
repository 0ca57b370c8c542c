"""Run history as a table (H1-H4).

Entries live in a Parquet folder (one row per run).  Retention keeps the
newest ``HISTORY_PER_USER`` entries of each user with a per-user
``row_number() <= k`` window, which Spark plans as a WindowGroupLimit: each map
task forwards at most k rows per user, so a user owning a third of all entries
does not put them all through one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import HISTORY_PER_USER
from .commits import CommitLog

HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("original_format", T.StringType(), False),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("column_count", T.LongType(), True),
    T.StructField("quality_score_before", T.LongType(), True),
    T.StructField("quality_score_after", T.LongType(), True),
    T.StructField("file_content", T.StringType(), True),
    T.StructField("report_json", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])

META_COLUMNS = ["id", "filename", "original_format", "row_count", "column_count",
                "quality_score_before", "quality_score_after", "created_at"]


def _newest_first():
    return [F.col("created_at").desc(), F.col("id").desc()]


def retain(history: DataFrame, keep: int = HISTORY_PER_USER) -> DataFrame:
    """Keep the newest ``keep`` entries of every user."""
    w = Window.partitionBy("user_id").orderBy(*_newest_first())
    return history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def history_append(history: DataFrame, entries: DataFrame, keep: int = HISTORY_PER_USER) -> DataFrame:
    """H1: add entries, then keep the newest ``keep`` per user."""
    return retain(history.unionByName(entries, allowMissingColumns=True), keep)


def history_recent(history: DataFrame, user_id, limit: int = 10) -> DataFrame:
    """H2: a user's newest min(limit, 50) entries, metadata columns only."""
    n = min(limit, HISTORY_PER_USER)
    return (history.where(F.col("user_id") == user_id).select(*META_COLUMNS)
            .orderBy(*_newest_first()).limit(n))


def history_get(history: DataFrame, entry_id, user_id) -> DataFrame:
    """H3: one entry of one user (empty if absent)."""
    return history.where((F.col("id") == entry_id) & (F.col("user_id") == user_id))


def history_delete(history: DataFrame, entry_id, user_id) -> DataFrame:
    """H4: remove one entry of one user."""
    return history.where(~((F.col("id") == entry_id) & (F.col("user_id") == user_id)))


def history_clear(history: DataFrame, user_id) -> DataFrame:
    """H4: remove every entry of one user."""
    return history.where(F.col("user_id") != user_id)


class HistoryStore:
    """A history table in a shared folder, for many writers at once.

    Entries lie in buckets by a hash of their user.  Every change writes a folder of its own and then commits, with the log's next number,
    which of its buckets hold which parts (commits.py).  Nothing is overwritten, and a write that was not committed is
    never read.

    ``append`` adds parts, so appends never hinder each other: the one that loses a number takes the next.
    The newest entries of a user are the same whether retention runs before or after two appends are put together, so it runs when
    they are read.  ``delete`` and ``clear`` replace their user's bucket, and read it again if it changed meanwhile.  A bucket of
    over ``max_parts`` parts is put together after an append, and the number of buckets doubles when they hold over
    ``rows_per_bucket`` rows on average.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, max_parts: int = 8, rows_per_bucket: int = 1_000_000):
        self.spark, self.path, self.max_parts, self.rows_per_bucket = spark, path.rstrip("/"), max_parts, rows_per_bucket
        self.log = CommitLog(spark, self.path, {"buckets": buckets, "parts": {}}, self._fold)

    @staticmethod
    def _fold(state: dict, entry: dict) -> dict:
        parts = state["parts"] if entry["buckets"] == state["buckets"] else {}
        for b, rows in entry["rows"].items():
            before = parts.get(b, []) if entry["adds"] else []
            parts[b] = [*before, [entry["folder"], rows]] if rows else before
        return {"buckets": entry["buckets"], "parts": {b: p for b, p in parts.items() if p}}

    # -- reading

    def _part(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(HISTORY_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], HISTORY_SCHEMA)

    def _read(self, state: dict, buckets: list[str] | None = None) -> DataFrame:
        """The entries of some buckets; a bucket of one part is within retention already."""
        parts = {b: p for b, p in state["parts"].items() if buckets is None or b in buckets}
        one, more = ([f"{self.path}/{f}/bucket={b}" for b, p in sorted(parts.items()) if (len(p) > 1) == several for f, _ in p]
                     for several in (False, True))
        out = self._part(one)
        return out.unionByName(retain(self._part(more))) if more else out

    def table(self) -> DataFrame:
        return self._read(self.log.head()[1])

    # -- writing

    @staticmethod
    def _bucket(buckets: int):
        return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")

    def _write(self, entries: DataFrame, buckets: int) -> tuple[str, dict[str, int]]:
        """A new folder with ``entries`` by bucket, and the rows of each (a number for each bucket)."""
        folder = f"data-{uuid.uuid4().hex}"
        rows = entries.select(*HISTORY_SCHEMA.fieldNames()).withColumn("bucket", self._bucket(buckets))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        try:
            written = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("bucket").count().collect()
        except AnalysisException:                      # no row, so no file and no schema
            written = []
        return folder, {str(r["bucket"]): r["count"] for r in written}

    def _replace(self, of: Callable[[dict], list[str]], change: Callable[[DataFrame], DataFrame], grow: int = 1) -> None:
        """Put what ``change`` makes of the entries of some buckets in their place."""
        def decide(state):
            buckets = of(state)
            if not buckets:
                return None, None
            seen = {b: state["parts"].get(b, []) for b in buckets}
            folder, rows = self._write(change(self._read(state, buckets)), state["buckets"] * grow)
            rows = rows if grow > 1 else {b: rows.get(b, 0) for b in buckets}
            return ({"adds": False, "folder": folder, "buckets": state["buckets"] * grow, "rows": rows},
                    lambda now: now["buckets"] == state["buckets"] and of(now) == buckets
                    and {b: now["parts"].get(b, []) for b in buckets} == seen)
        self.log.append(decide)

    def append(self, entries: DataFrame) -> DataFrame:
        """H1: add entries, then keep the newest of every user."""
        empty = self.spark.createDataFrame([], HISTORY_SCHEMA)
        new = retain(empty.unionByName(entries, allowMissingColumns=True))
        written: dict[int, tuple[str, dict]] = {}

        def decide(state):
            n = state["buckets"]
            if n not in written:
                written[n] = self._write(new, n)
            folder, rows = written[n]
            entry = {"adds": True, "folder": folder, "buckets": n, "rows": rows}
            return (entry if rows else None), lambda now: now["buckets"] == n
        if self.log.append(decide):
            self.compact()
        return self.table()

    def compact(self) -> None:
        """Put the parts of full buckets together; make more buckets if they are large."""
        self._replace(lambda s: sorted(b for b, p in s["parts"].items() if len(p) > self.max_parts), lambda old: old)

        def large(state):
            rows = sum(n for p in state["parts"].values() for _, n in p)
            return sorted(state["parts"]) if rows > self.rows_per_bucket * state["buckets"] else []
        self._replace(large, lambda old: old, grow=2)

    def _of_user(self, user_id) -> Callable[[dict], list[str]]:
        user = self.spark.createDataFrame([(str(user_id),)], "user_id string")
        return lambda state: [b for b in [str(user.select(self._bucket(state["buckets"])).first()[0])] if b in state["parts"]]

    def delete(self, entry_id, user_id) -> DataFrame:
        self._replace(self._of_user(user_id), lambda old: history_delete(old, entry_id, user_id))
        return self.table()

    def clear(self, user_id) -> DataFrame:
        self._replace(self._of_user(user_id), lambda old: history_clear(old, user_id))
        return self.table()


def entries_from_events(events: DataFrame) -> DataFrame:
    """History entries derived from the ``events`` table (one per event), used to
    exercise retention at table scale: user = user_id, time = ts."""
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.col("event_type"), F.lit(".csv")).alias("filename"),
        F.lit("csv").alias("original_format"),
        F.lit(None).cast("long").alias("row_count"),
        F.lit(None).cast("long").alias("column_count"),
        F.floor(F.col("value")).cast("long").alias("quality_score_before"),
        F.lit(None).cast("long").alias("quality_score_after"),
        F.lit(None).cast("string").alias("file_content"),
        F.col("props").alias("report_json"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
