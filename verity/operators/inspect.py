"""Inspectors (I1-I12): profile a DataFrame once, turn the numbers into issues.

All per-column statistics of all inspectors are folded into one aggregate job (several for wide
tables, each over its own columns).  Only the duplicate check needs a shuffle, of row hashes
counted on the map side, and the outlier counts need one more
aggregate pass because their bounds come from the first.  Issues are a small
table (a few rows per column) built on the driver from those scalars; the
affected cells stay a lazy, distributed long-form DataFrame.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import CELLS_PER_ISSUE, EMAIL_NAME_WORDS, EMAIL_PATTERN
from ..functions.numeric import decimal_value, is_decimal_text, py_repr_double
from ..functions.text import (col_, has_edge_whitespace, is_lower_style, is_title_style,
                              is_upper_style, strip)
from .rowid import with_row_id

log = logging.getLogger(__name__)
AGGREGATES_PER_JOB = 96      # wider aggregates lose whole-stage code generation (100 fields)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)

ISSUE_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("inspector_name", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("count", T.LongType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("suggestion", T.StringType(), False),
])

CELL_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("row", T.LongType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])


@dataclass
class IssueSpec:
    """One finding.  ``cell_filter`` marks its affected rows in the input."""
    inspector_name: str
    category: str
    columns: list
    severity: str
    count: int
    description: str
    suggestion: str
    cell_filter: Column | None = None
    cell_value: Column | None = None
    cap: int | None = CELLS_PER_ISSUE
    cells: Callable[[int | None], DataFrame] | None = None  # custom cell frame (row, value)
    seq: int = -1


@dataclass
class Context:
    df: DataFrame
    row_id: str
    columns: list
    dtypes: dict
    stats: dict = field(default_factory=dict)
    cache: dict = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return int(self.stats["__rows__"])

    def is_string(self, c) -> bool:
        return isinstance(self.dtypes[c], T.StringType)

    def is_numeric(self, c) -> bool:
        return isinstance(self.dtypes[c], NUMERIC_TYPES)


def _k(col: str, what: str) -> str:
    return f"{what}::{col}"


def value_text(ctx: Context, c: str) -> Column:
    """``str(value)`` of a cell the way Python would print it."""
    dt = ctx.dtypes[c]
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return py_repr_double(col_(c).cast("double"))
    if isinstance(dt, T.BooleanType):
        return F.when(col_(c), "True").otherwise("False")
    return col_(c).cast("string")


def py_repr_str(c: Column) -> Column:
    """Python ``repr()`` of a string (quotes and common escapes)."""
    esc = F.regexp_replace(c, r"\\", r"\\\\")
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace(esc, "\n", r"\\n"), "\r", r"\\r"),
                           "\t", r"\\t")
    dq = (F.instr(c, "'") > 0) & (F.instr(c, '"') == 0)
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.regexp_replace(esc, "'", r"\\'"), F.lit("'")))


def numeric_view(ctx: Context, c: str) -> Column | None:
    """The column as double the way a lenient float cast reads it, or None if never."""
    dt = ctx.dtypes[c]
    if isinstance(dt, NUMERIC_TYPES) or isinstance(dt, T.BooleanType):
        return col_(c).cast("double")
    if isinstance(dt, T.StringType):
        return decimal_value(col_(c))
    return None


# ---------------------------------------------------------------------------
# Inspector contract (I12): aggregates() feeds the one shared profile job,
# issues() turns the numbers into findings.  Users may append their own.
# ---------------------------------------------------------------------------

class Inspector:
    name = "inspector"
    category = "consistency"
    additive = True      # aggregates() are counts: those of two parts of a table add up to the table's (see profile.py)

    def aggregates(self, ctx: Context) -> dict:
        return {}

    def issues(self, ctx: Context) -> list:
        return []


class DuplicateRows(Inspector):
    """I1 count (rows - distinct rows) and I2 positions of 2nd+ occurrences."""
    name, category = "Duplicate Rows", "uniqueness"

    def issues(self, ctx):
        dup = duplicate_count(ctx)
        if dup <= 0:
            return []
        return [IssueSpec(
            self.name, self.category, ["*all*"], "warning", dup,
            f"Found {dup} exact duplicate row(s).",
            "Remove duplicates or verify that they represent legitimate repeated entries.",
            cells=lambda cap: duplicate_positions(ctx.df, ctx.row_id, ctx.columns, cap)
            .select(F.col("row"), F.lit("duplicate").alias("value")),
        )]


def row_hash(columns, dtypes: dict | None = None, salt: int | None = None) -> Column:
    """64-bit hash of a whole row; nulls are tagged so (null, "a") != ("a", null).

    Floating values are normalised first (-0.0 -> 0.0, one NaN), as grouping
    treats them as equal; otherwise equal rows could hash apart.
    """
    dtypes = dtypes or {}
    parts = [] if salt is None else [F.lit(salt)]
    for c in columns:
        v = col_(c)
        if isinstance(dtypes.get(c), (T.DoubleType, T.FloatType)):
            v = F.when(F.isnan(v), F.lit(float("nan")).cast(dtypes[c])).when(v == 0, F.lit(0).cast(dtypes[c])) \
                .otherwise(v)
        elif isinstance(dtypes.get(c), T.MapType):
            v = F.to_json(v, {"ignoreNullFields": "false"})
        parts.append(F.struct(col_(c).isNull().alias("n"), v.alias("v")))
    return F.xxhash64(*parts)


def row_prints(df: DataFrame, row_id: str, columns, *more: Column) -> DataFrame:
    """(row, h1, h2, more...): rows stand for themselves by 128 bits of hash from here on.

    Wide rows are never shuffled to compare them; among n rows two different ones agree
    with probability n**2 / 2**129.
    """
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    return df.select(col_(row_id).alias("row"), row_hash(columns, dtypes).alias("h1"),
                     row_hash(columns, dtypes, salt=1).alias("h2"), *more)


def repeated(prints: DataFrame) -> DataFrame:
    """The 2nd+ occurrences among ``row_prints``: rows that are not the first of their group.

    Groups are counted on the map side, so a row that fills a third of the table is one count per task; the
    join back is on plain new columns, which lets AQE split such a key.
    """
    first = prints.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1") \
        .select(F.col("h1").bitwiseXOR(F.lit(0).cast("long")).alias("h1"),
                F.col("h2").bitwiseXOR(F.lit(0).cast("long")).alias("h2"), "first")
    return prints.join(first, ["h1", "h2"]).where(F.col("row") > F.col("first"))


def duplicate_count(ctx: Context) -> int:
    """Rows minus distinct rows, in one shuffle of hash counts."""
    if "dup" not in ctx.cache:
        groups = row_prints(ctx.df, ctx.row_id, ctx.columns).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        n = groups.where("n > 1").agg(F.sum(F.col("n") - 1).alias("d")).first()["d"]
        ctx.cache["dup"] = int(n or 0)
    return ctx.cache["dup"]


def duplicate_positions(df: DataFrame, row_id: str, columns,
                        cap: int | None = CELLS_PER_ISSUE) -> DataFrame:
    """Row ids of repeated rows (2nd+ occurrence), the first ``cap`` in row order (None: all)."""
    rows = repeated(row_prints(df, row_id, columns)).select("row")
    return rows if cap is None else rows.orderBy("row").limit(cap)


class FormatInconsistency(Inspector):
    """I3/I4 casing styles and I5 edge whitespace, string columns only."""
    name, category = "Format Inconsistency", "format"

    def aggregates(self, ctx):
        out = {}
        for c in ctx.columns:
            if not ctx.is_string(c):
                continue
            v = col_(c)
            out[_k(c, "lower")] = F.count_if(v.isNotNull() & is_lower_style(v))
            out[_k(c, "upper")] = F.count_if(v.isNotNull() & is_upper_style(v))
            out[_k(c, "title")] = F.count_if(v.isNotNull() & is_title_style(v))
            out[_k(c, "ws")] = F.count_if(has_edge_whitespace(v))
        return out

    def issues(self, ctx):
        out = []
        s = ctx.stats
        for c in ctx.columns:
            if not ctx.is_string(c) or s[_k(c, "nn")] < 2:
                continue
            lo, up, ti = s[_k(c, "lower")], s[_k(c, "upper")], s[_k(c, "title")]
            total = lo + up + ti
            if total > 0:
                mx = max(lo, up, ti)
                bad = total - mx
                if bad > 0 and mx / total < 0.95:
                    if mx == ti:
                        dom, pred = "Title Case", ~is_title_style(col_(c))
                    elif mx == lo:
                        dom, pred = "lowercase", col_(c) != F.lower(col_(c))
                    else:
                        dom, pred = "UPPERCASE", col_(c) != F.upper(col_(c))
                    out.append(IssueSpec(
                        self.name, self.category, [c], "info", bad,
                        f"Column '{c}' has inconsistent casing. Dominant style: {dom} ({mx}/{total}).",
                        f"Standardize all values to {dom}.",
                        cell_filter=col_(c).isNotNull() & pred, cell_value=col_(c)))
            ws = s[_k(c, "ws")]
            if ws > 0:
                out.append(IssueSpec(
                    "Whitespace Issues", self.category, [c], "info", ws,
                    f"Column '{c}' has {ws} value(s) with leading/trailing whitespace.",
                    "Strip whitespace from all values in this column.",
                    cell_filter=has_edge_whitespace(col_(c)), cell_value=py_repr_str(col_(c))))
        return out


class MissingValues(Inspector):
    """Every null cell, critical above 30% of rows."""
    name, category = "Missing Values", "completeness"

    def issues(self, ctx):
        out = []
        n = ctx.rows
        for c in ctx.columns:
            nulls = n - ctx.stats[_k(c, "nn")]
            if nulls == 0:
                continue
            sev = "critical" if nulls / n > 0.3 else "warning"
            out.append(IssueSpec(
                self.name, self.category, [c], sev, nulls,
                f"Column '{c}' has {nulls} missing value(s) out of {n} rows ({100 * nulls / n:.1f}%).",
                "Fill missing values with the column median (numeric) or mode (text), "
                "or investigate why data is absent.",
                cell_filter=col_(c).isNull(), cell_value=F.lit(None).cast("string"), cap=None))
        return out


class Outliers(Inspector):
    """Values beyond mean +- 3 sample standard deviations."""
    name, category = "Outlier Detection", "accuracy"

    def aggregates(self, ctx):
        out = {}
        for c in ctx.columns:
            x = numeric_view(ctx, c)
            if x is None:
                continue
            out[_k(c, "num")] = F.count(x)
            out[_k(c, "mean")] = F.avg(x)
            out[_k(c, "std")] = F.stddev_samp(x)
        return out

    def candidates(self, ctx):
        res = []
        n = ctx.rows
        for c in ctx.columns:
            if _k(c, "num") not in ctx.stats:
                continue
            num = ctx.stats[_k(c, "num")]
            if not ctx.is_numeric(c) and num / max(n, 1) < 0.5:
                continue
            if num < 4:
                continue
            mean, std = ctx.stats[_k(c, "mean")], ctx.stats[_k(c, "std")]
            if std is None or std == 0 or std != std:
                continue
            res.append((c, mean - 3 * std, mean + 3 * std))
        return res

    def issues(self, ctx):
        cands = self.candidates(ctx)
        if not cands:
            return []
        preds = {c: (numeric_view(ctx, c) < lo) | (numeric_view(ctx, c) > hi) for c, lo, hi in cands}
        if "outliers" in ctx.cache:                      # counts from elsewhere: (column, low, high) rows to {column: count}
            counts = ctx.cache["outliers"](cands)
        else:
            counts = aggregate_in_groups(ctx.df, {c: F.count_if(F.coalesce(p, F.lit(False))) for c, p in preds.items()})
        out = []
        for c, _lo, _hi in cands:
            k = int(counts[c])
            if k > 0:
                out.append(IssueSpec(
                    self.name, self.category, [c], "warning", k,
                    f"Column '{c}' has {k} statistical outlier(s) (>3σ from mean).",
                    "Review these values. They may be data entry errors or legitimate edge cases.",
                    cell_filter=F.coalesce(preds[c], F.lit(False)), cell_value=value_text(ctx, c)))
        return out


def email_named(c: str) -> bool:
    lc = c.lower().replace(" ", "_")
    return any(k in lc for k in EMAIL_NAME_WORDS)


class SchemaValidation(Inspector):
    """I8 invalid e-mail text and I9 entirely empty columns."""
    name, category = "Schema Validation", "accuracy"

    @staticmethod
    def _bad(c):
        return col_(c).isNotNull() & ~strip(col_(c)).rlike(EMAIL_PATTERN)

    def aggregates(self, ctx):
        return {_k(c, "bad_email"): F.count_if(self._bad(c))
                for c in ctx.columns if email_named(c) and ctx.is_string(c)}

    def issues(self, ctx):
        out = []
        for c in ctx.columns:
            if not (email_named(c) and ctx.is_string(c)) or ctx.stats[_k(c, "nn")] == 0:
                continue
            bad = ctx.stats[_k(c, "bad_email")]
            if bad > 0:
                out.append(IssueSpec(
                    self.name, "accuracy", [c], "critical", bad,
                    f"Column '{c}' (email) has {bad} invalid email address(es).",
                    "Repair or remove invalid email addresses.",
                    cell_filter=self._bad(c), cell_value=col_(c)))
        for c in ctx.columns:
            if ctx.stats[_k(c, "nn")] == 0:
                out.append(IssueSpec(
                    self.name, "completeness", [c], "info", ctx.rows,
                    f"Column '{c}' is entirely empty.",
                    "Remove this column or populate it with data."))
        return out


class TypeMismatch(Inspector):
    """A mostly numeric text column (60-100% castable) with some text."""
    name, category = "Type Mismatch", "consistency"

    def aggregates(self, ctx):
        return {_k(c, "castable"): F.count_if(is_decimal_text(col_(c)))
                for c in ctx.columns if ctx.is_string(c)}

    def issues(self, ctx):
        out = []
        for c in ctx.columns:
            if not ctx.is_string(c):
                continue
            total = ctx.stats[_k(c, "nn")]
            if total == 0:
                continue
            num = ctx.stats[_k(c, "castable")]
            if 0.6 < num / total < 1.0:
                bad = total - num
                out.append(IssueSpec(
                    self.name, self.category, [c], "warning", bad,
                    f"Column '{c}' appears numeric but has {bad} non-numeric value(s).",
                    "Convert non-numeric entries or separate them into a different column.",
                    cell_filter=col_(c).isNotNull() & ~is_decimal_text(col_(c)),
                    cell_value=col_(c)))
        return out


DEFAULT_INSPECTORS = (DuplicateRows, FormatInconsistency, MissingValues, Outliers,
                      SchemaValidation, TypeMismatch)


# ---------------------------------------------------------------------------
# Driver: profile once, run the inspectors, assemble issues and cells
# ---------------------------------------------------------------------------

@dataclass
class Inspection:
    ctx: Context
    specs: list

    @property
    def rows(self) -> int:
        return self.ctx.rows

    @property
    def columns(self) -> list:
        return self.ctx.columns

    def issues(self) -> DataFrame:
        spark = self.ctx.df.sparkSession
        rows = [(s.seq, s.inspector_name, s.category, ", ".join(s.columns), s.severity, int(s.count),
                 s.description, s.suggestion) for s in self.specs]
        return spark.createDataFrame(rows, ISSUE_SCHEMA)

    def cells(self, cap: int | None = CELLS_PER_ISSUE, every: int | None = None) -> DataFrame:
        """Long-form affected cells: first ``cap`` per issue in row order
        (missing-value issues list all of theirs, as in the original; with ``every`` the first so many)."""
        ctx = self.ctx
        spark = ctx.df.sparkSession
        rid = col_(ctx.row_id).cast("long")
        capped, uncapped, custom = [], [], []
        for s in self.specs:
            if s.cells is not None:
                custom.append(s.cells(cap if s.cap is not None else None).select(F.lit(s.seq).alias("seq"), F.col("row").cast("long"),
                                               F.lit(s.columns[0]).alias("column"),
                                               F.col("value").cast("string")))
            elif s.cell_filter is not None:
                entry = F.when(s.cell_filter, F.struct(F.lit(s.seq).alias("seq"),
                                                       F.lit(s.columns[0]).alias("column"),
                                                       s.cell_value.cast("string").alias("value")))
                (capped if every is not None or (s.cap is not None and cap is not None) else uncapped).append(entry)
        parts = []
        for entries, limited in ((capped, True), (uncapped, False)):
            if not entries:
                continue
            long = (ctx.df.select(rid.alias("row"), F.explode(F.array(*entries)).alias("e"))
                    .where(F.col("e").isNotNull())
                    .select(F.col("e.seq").alias("seq"), "row", F.col("e.column").alias("column"),
                            F.col("e.value").alias("value")))
            if limited:
                w = Window.partitionBy("seq").orderBy("row")
                long = (long.withColumn("_rn", F.row_number().over(w))
                        .where(F.col("_rn") <= (every or cap)).drop("_rn"))
            parts.append(long)
        parts.extend(custom)
        if not parts:
            return spark.createDataFrame([], CELL_SCHEMA)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def aggregate_in_groups(df: DataFrame, aggs: dict) -> dict:
    """Scalars of many aggregates; each job takes as many as whole-stage code generation can."""
    names, out = list(aggs), {}
    for at in range(0, len(names), AGGREGATES_PER_JOB):
        part = names[at:at + AGGREGATES_PER_JOB]
        row = df.agg(*[aggs[n].alias(f"a{i}") for i, n in enumerate(part)]).first()
        out.update((n, row[f"a{i}"]) for i, n in enumerate(part))
    return out


def _isolated(what: str, inspector, call):
    """An inspector that fails is logged and left out; the others go on."""
    try:
        return call()
    except Exception:  # noqa: BLE001  whatever a custom inspector raises
        log.exception("inspector %r failed in %s", getattr(inspector, "name", inspector), what)
        return None


def _prepared(df: DataFrame, row_id: str, inspectors) -> tuple[Context, list, dict]:
    """The context, the inspectors whose aggregates can be asked for, and these (by inspector), before any job."""
    columns = [c for c in df.columns if c != row_id]
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    ctx = Context(df, row_id, columns, dtypes)
    insts = [i() if isinstance(i, type) else i for i in (inspectors or DEFAULT_INSPECTORS)]
    own = {id(i): _isolated("aggregates", i, lambda i=i: dict(i.aggregates(ctx))) for i in insts}
    return ctx, [i for i in insts if own[id(i)] is not None], own


def base_aggregates(ctx: Context) -> dict:
    """Rows, and the values of each column that are there."""
    return {"__rows__": F.count(F.lit(1))} | {_k(c, "nn"): F.count(col_(c)) for c in ctx.columns}


def _judged(ctx: Context, insts) -> Inspection:
    """The findings, once the profile's numbers are known."""
    if ctx.rows == 0:
        raise ValueError("empty table: nothing to inspect")
    specs = []
    for i in insts:
        specs.extend(_isolated("issues", i, lambda i=i: list(i.issues(ctx))) or [])
    for i, s in enumerate(specs):
        s.seq = i
    return Inspection(ctx, specs)


def inspect(df: DataFrame, row_id: str = "_row_id", inspectors=None) -> Inspection:
    """Run all inspectors over ``df``.

    ``row_id`` orders the rows and is not inspected; a table without it (an upload, a join) gets one
    (see ``rowid.with_row_id``).  A failing inspector is logged and skipped.
    """
    if row_id not in df.columns:
        df = with_row_id(df, row_id)
    ctx, insts, own = _prepared(df, row_id, inspectors)
    aggs = base_aggregates(ctx)
    try:
        ctx.stats = aggregate_in_groups(df, aggs | {n: a for i in insts for n, a in own[id(i)].items()})
    except Exception:  # noqa: BLE001  an expression of some inspector: each one by itself
        ctx.stats = aggregate_in_groups(df, aggs)
        for i in list(insts):
            got = _isolated("aggregates", i, lambda i=i: aggregate_in_groups(df, own[id(i)]))
            if got is None:
                insts.remove(i)
            else:
                ctx.stats.update(got)
    return _judged(ctx, insts)


def write_and_inspect(df: DataFrame, path: str, row_id: str = "_row_id", inspectors=None, mode: str = "errorifexists") -> Inspection:
    """Write ``df`` as Parquet and inspect what was written, without a scan for the profile.

    The profile's aggregates are observed on the rows as they are written (``DataFrame.observe``); only what depends on them (outliers)
    or needs a shuffle (duplicates) reads the written table.  The table needs a row id; a failing inspector is logged and skipped
    where its expressions do not resolve, and fails the write where they fail on the data.
    """
    if row_id not in df.columns:
        raise ValueError(f"the table has no column {row_id}")
    ctx, insts, own = _prepared(df, row_id, inspectors)
    aggs = base_aggregates(ctx) | {n: a for i in insts for n, a in own[id(i)].items()}
    names, seen, watched = list(aggs), [], df
    for at in range(0, len(names), AGGREGATES_PER_JOB):
        o = Observation()
        part = [aggs[n].alias(f"a{at + i}") for i, n in enumerate(names[at:at + AGGREGATES_PER_JOB])]
        watched = watched.observe(o, *part)
        seen.append(o)
    watched.write.mode(mode).parquet(path)
    got = {k: v for o in seen for k, v in o.get.items()}
    ctx.df = df.sparkSession.read.schema(df.schema).parquet(path)
    ctx.stats = {n: got.get(f"a{i}", 0) for i, n in enumerate(names)}
    return _judged(ctx, insts)
