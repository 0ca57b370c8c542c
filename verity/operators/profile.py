"""A table's profile that grows with it: parts are profiled alone and merged.

What the inspectors ask of a table is kept as mergeable state:

* counts, which add up;
* moments (count, mean, sum of squared deviations), merged as Welford's method does, for the outliers' bounds;
* the number of rows of each row hash, for duplicates across parts;
* the number of rows of each numeric value.  Outliers depend on bounds that move as parts come, so they are counted
  again from these numbers at every reading; they lie sorted by column and value, and only the row groups beyond the bounds are read.

An appended part costs one pass over itself.  The data of earlier parts is never read again.  The parts that belong to the profile are
named by a commit log, so several writers can add parts at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import CommitLog
from .inspect import (DEFAULT_INSPECTORS, Context, Inspection, Outliers, _judged, _k, aggregate_in_groups, base_aggregates, numeric_view,
                      row_prints)


def merge_moments(a: tuple, b: tuple) -> tuple:
    """(count, mean, sum of squared deviations) of two parts together."""
    (n, x, s), (m, y, t) = a, b
    if not n or not m:
        return a if n else b
    d = y - x
    return n + m, x + d * m / (n + m), s + t + d * d * n * m / (n + m)


class ProfileStore:
    """The merged profile of the parts of one table, in a shared folder.

    Inspectors whose aggregates are not counts (``additive = False``) cannot be merged and are refused; the outlier inspector's moments
    are merged by their own rule.  All parts have the columns and types of the first.
    """

    def __init__(self, spark, path: str, row_id: str = "_row_id", inspectors=None):
        self.spark, self.path, self.row_id = spark, path.rstrip("/"), row_id
        self.inspectors = [i() if isinstance(i, type) else i for i in (inspectors or DEFAULT_INSPECTORS)]
        odd = [i.name for i in self.inspectors if not i.additive]
        if odd:
            raise ValueError(f"inspectors whose aggregates do not add up: {odd}")
        self.log = CommitLog(spark, self.path, {"parts": [], "schema": None, "counts": {}, "moments": {}}, self._fold)

    @staticmethod
    def _fold(state: dict, entry: dict) -> dict:
        counts, moments = dict(state["counts"]), dict(state["moments"])
        for k, v in entry["counts"].items():
            counts[k] = counts.get(k, 0) + v
        for c, m in entry["moments"].items():
            moments[c] = list(merge_moments(tuple(moments.get(c, (0, 0.0, 0.0))), tuple(m)))
        return {"parts": [*state["parts"], entry["part"]], "schema": entry["schema"], "counts": counts, "moments": moments}

    def _context(self, df: DataFrame) -> Context:
        columns = [c for c in df.columns if c != self.row_id]
        return Context(df, self.row_id, columns, {f.name: f.dataType for f in df.schema.fields})

    def add(self, df: DataFrame) -> None:
        """Profile one part and commit it."""
        ctx = self._context(df)
        schema = T.StructType([f for f in df.schema.fields if f.name != self.row_id])
        part = f"part-{uuid.uuid4().hex}"
        numeric = {c: x for c in ctx.columns if (x := numeric_view(ctx, c)) is not None}
        counts = base_aggregates(ctx)
        for i in self.inspectors:
            if not isinstance(i, Outliers):
                counts |= dict(i.aggregates(ctx))
        moments = {}
        for c, x in numeric.items():
            moments |= {("n", c): F.count(x), ("mean", c): F.avg(x), ("m2", c): F.var_pop(x) * F.count(x)}
        got = aggregate_in_groups(df, counts | moments)
        row_prints(df, self.row_id, ctx.columns).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")) \
            .write.parquet(f"{self.path}/{part}/rows")
        self._values(df, numeric).write.parquet(f"{self.path}/{part}/values")
        entry = {"part": part, "schema": schema.json(), "counts": {k: got[k] for k in counts},
                 "moments": {c: (got["n", c], got["mean", c] or 0.0, got["m2", c] or 0.0) for c in numeric}}

        def decide(state):
            if state["schema"] is not None and T.StructType.fromJson(_parsed(state["schema"])).simpleString() != schema.simpleString():
                raise ValueError("a part has other columns than the profile")
            return entry, lambda now: now["schema"] in (None, entry["schema"])
        self.log.append(decide)

    def _values(self, df: DataFrame, numeric: dict) -> DataFrame:
        """(column, value, n), sorted: how often each numeric value occurs."""
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), x.alias("value")) for c, x in numeric.items()]) if numeric \
            else F.array().cast("array<struct<column:string,value:double>>")
        rows = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").where("value is not null")
        counted = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return counted.repartitionByRange(n, "column", "value").sortWithinPartitions("column", "value")

    def _outliers(self, parts: list[str], candidates) -> dict:
        """{column: rows beyond its bounds}, from the counts of values; the bounds reach the Parquet scan as filters."""
        values = self.spark.read.parquet(*[f"{self.path}/{p}/values" for p in parts])
        beyond = F.lit(False)
        for c, lo, hi in candidates:
            beyond = beyond | ((F.col("column") == c) & ((F.col("value") < lo) | (F.col("value") > hi)))
        found = {r["column"]: r["n"] for r in values.where(beyond).groupBy("column").agg(F.sum("n").alias("n")).collect()}
        return {c: found.get(c, 0) for c, _, _ in candidates}

    def inspection(self) -> Inspection:
        """The findings over all parts: issues and scores as of one inspection of the whole table (without cells, as it holds no rows)."""
        _, state = self.log.head()
        if not state["parts"]:
            raise ValueError("empty table: nothing to inspect")
        fields = T.StructType.fromJson(_parsed(state["schema"])).fields
        ctx = self._context(self.spark.createDataFrame([], T.StructType([T.StructField(self.row_id, T.LongType()), *fields])))
        ctx.stats = dict(state["counts"])
        for c, (n, mean, m2) in state["moments"].items():
            ctx.stats |= {_k(c, "num"): n, _k(c, "mean"): mean if n else None, _k(c, "std"): (m2 / (n - 1)) ** 0.5 if n > 1 else None}
        rows = self.spark.read.parquet(*[f"{self.path}/{p}/rows" for p in state["parts"]])
        again = rows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").agg(F.sum(F.col("n") - 1).alias("d")).first()["d"]
        ctx.cache["dup"] = int(again or 0)
        ctx.cache["outliers"] = lambda candidates: self._outliers(state["parts"], candidates)
        return _judged(ctx, self.inspectors)


def _parsed(schema: str) -> dict:
    import json
    return json.loads(schema)
