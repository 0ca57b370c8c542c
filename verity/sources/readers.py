"""Sources (S1-S8, S10, S15): reading tables the way an upload was read.

All readers return a lazy DataFrame; the clean-up helpers need at most one
aggregate over the data (never a collect of rows).
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import DECIMAL_TEXT
from ..functions.text import col_
from ..operators.inspect import aggregate_in_groups

JUNK_COLUMN = re.compile(r"^(Unnamed|__)")


INTEGER_TEXT = r"^[+-]?[0-9]{1,18}$"
BOOLEAN_TEXT = r"^(?i:true|false)$"
LATIN_1 = "ISO-8859-1"


def by_encoding(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The text files under ``path`` by encoding, UTF-8 or else latin-1; no names (an empty list: all of them) if they are alike.

    The bytes of every line are validated where they lie: no byte of a longer UTF-8 sequence is a line break, so a file is UTF-8
    if its lines are, and large files are checked by many tasks.  Only the names of files reach the driver, which has listed them anyway.
    """
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok")) \
        .groupBy("file").agg(F.bool_and("ok").alias("ok"))
    kinds = {r["ok"] for r in files.select("ok").distinct().collect()}
    if len(kinds) < 2:
        return {LATIN_1 if False in kinds else "UTF-8": []}
    rows = files.collect()
    return {charset: sorted(r["file"] for r in rows if r["ok"] == ok) for charset, ok in (("UTF-8", True), (LATIN_1, False))}


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = "UTF-8",
             infer: bool = True, multiline: bool = True) -> DataFrame:
    """Header CSV (or TSV with ``sep='\\t'``) by RFC 4180, missing cells null.

    A quoted cell may hold separators, doubled quotes and newlines.  Such a file cannot be split, so a very large one that
    is known to hold no newline in a cell should be read with ``multiline=False``.  Columns that hold only
    numbers or only booleans get that type; everything else, dates included, stays the text that it was.
    ``encoding=None`` chooses for each file: UTF-8 if all its bytes are, else latin-1 (S2); the files of
    one encoding share their header, and a column that those of the other lack is null there.
    """
    reader = (spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("multiLine", multiline)
              .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE"))
    df = None
    for charset, files in ({encoding: []} if encoding else by_encoding(spark, path)).items():
        some = reader.option("encoding", charset).csv([_literal(f) for f in files] or path)
        df = some if df is None else df.unionByName(some, allowMissingColumns=True)
    return infer_scalars(df) if infer else df


def read_tsv(spark: SparkSession, path: str, encoding: str | None = "UTF-8", infer: bool = True, multiline: bool = True) -> DataFrame:
    return read_csv(spark, path, "\t", encoding, infer, multiline)


def infer_scalars(df: DataFrame) -> DataFrame:
    """Text columns that hold only integers, only decimals or only booleans, as such (one aggregate for all columns)."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    kinds = (("long", INTEGER_TEXT), ("double", DECIMAL_TEXT), ("boolean", BOOLEAN_TEXT))
    seen = aggregate_in_groups(df, {(c, k): F.bool_and(col_(c).rlike(rx)) for c in names for k, rx in kinds})
    kind = {c: next((k for k, _ in kinds if seen[c, k]), None) for c in names}
    return df.select(*[col_(c).cast(kind[c]).alias(c) if kind.get(c) else col_(c) for c in df.columns])


def _one_object(x):
    """Whether a line is one JSON object: it has keys, and no closing bracket stands right before an opening one outside strings."""
    return F.json_object_keys(x).isNotNull() & ~_bare(x).rlike(r"[}\]]\s*[{\[]")


def _bare(x):
    """JSON text without the contents of its strings, in which no value has a closing bracket right before an opening one."""
    return F.regexp_replace(F.regexp_replace(x, r"(?s)\\.", ""), r'"[^"]*+"', '""')


def json_lines_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines): for each file under ``path``, whether it is JSON Lines: two objects or more, one a line.

    Only counts over the lines are taken, so a large file is judged by many tasks and none holds it.  Empty files are not in the result.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim(F.translate("value", "\t\r", "  ")).alias("x"))
    return lines.where("x <> ''").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(_one_object(F.col("x"))).alias("objects")) \
        .select("file", ((F.col("n") > 1) & (F.col("n") == F.col("objects"))).alias("lines"))


def json_shapes(spark: SparkSession, path: str, record_field: str | None = None) -> dict[tuple[str, str | None], list[str]]:
    """The JSON files under ``path`` by shape: (kind, field) and the files that have it (an empty list: all of them).

    Kind "lines" is JSON Lines, one object a line; "value" is one value a file.  ``field`` is the field with the records
    of a file that is one object: its first whose value is a list (in the order of the file), or ``record_field`` if
    that is a list; None if there is none.  A file of several values that are not one object a line is an error.

    JSON Lines are told by counts over their lines.  Only the other files are looked at whole, as they are one value, which
    one task reads in any case (so such a file is bounded by what a task holds, 2 GB at most).
    """
    by_line = json_lines_files(spark, path)
    kinds = {r["lines"]: r["n"] for r in by_line.groupBy("lines").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(kinds) <= {True}:
        return {("lines", None): []} if kinds else {}
    named = by_line.collect() if True in kinds else []                       # the files' names, which the driver has listed anyway
    lines = sorted(r["file"] for r in named if r["lines"])
    rest = [_literal(r["file"]) for r in named if not r["lines"]] or path
    value = F.col("value")
    files = spark.read.text(rest, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"),
                                                         _bare(value).rlike(r"[}\]]\s*[{\[]").alias("several"))
    keys = F.json_object_keys("value") if record_field is None else F.array(F.lit(record_field))
    fields = F.from_json("value", "map<string,string>")
    first = F.try_element_at(F.filter(keys, lambda k: F.try_element_at(fields, k).rlike(r"^\s*\[")), F.lit(1))
    kind = F.when(F.col("several"), F.lit("bad")).otherwise(F.lit("value"))
    found = files.where("trim(translate(value, '\t\r\n', '   ')) <> ''").select("file", kind.alias("kind"), F.when(value.rlike(r"^\s*\{"), first).alias("field"))
    shapes = {(r["kind"], r["field"]): sorted(r["files"])
              for r in found.groupBy("kind", "field").agg(F.collect_list("file").alias("files")).collect()}
    for (k, _), names in shapes.items():
        if k == "bad":
            raise ValueError(f"JSON files with several values that are not one object a line: {names[:5]}")
    if lines:
        shapes["lines", None] = lines
    return dict(sorted(shapes.items(), key=lambda x: x[1])) if len(shapes) > 1 else {k: [] for k in shapes}


def read_json_records(spark: SparkSession, path: str, record_field: str | None = None,
                      multiline: bool = True) -> DataFrame:
    """JSON records as text columns; nested values become JSON text.

    A file that is one object gives the records of its first list-valued field (or of ``record_field``), and is one
    record if it has no list; each file is taken by its own shape, JSON Lines too, and a column that a file lacks is
    null.  With ``multiline=False`` every line is a record.
    """
    reader = spark.read.option("prefersDecimal", False).option("inferTimestamp", False)
    if not multiline:
        return flatten_nested_to_json(_records(reader.json(path), record_field))
    shapes = json_shapes(spark, path, record_field)
    out = None
    for (kind, field), files in shapes.items():
        df = reader.option("multiLine", kind == "value").json([_literal(f) for f in files] or path)
        df = flatten_nested_to_json(_records(df, field))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return flatten_nested_to_json(reader.option("multiLine", True).json(path)) if out is None else out


def _literal(file: str) -> str:
    """The path of a file that Spark names in its metadata, for a reader that takes patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def _records(df: DataFrame, field: str | None) -> DataFrame:
    """The records of a list-valued field, or the rows as they are."""
    if field is None or field not in df.columns:
        return df
    records = df.select(F.explode(col_(field)).alias("_r"))
    return records.select("_r.*") if isinstance(records.schema["_r"].dataType, T.StructType) \
        else records.withColumnRenamed("_r", field)


def flatten_nested_to_json(df: DataFrame) -> DataFrame:
    """S5 + cast to text: struct/array/map values as JSON text (null fields kept), the rest as text."""
    from ..functions.numeric import py_repr_double
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(col_(f.name), {"ignoreNullFields": "false"}).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(py_repr_double(col_(f.name).cast("double")).alias(f.name))
        else:
            out.append(col_(f.name).cast("string").alias(f.name))
    return df.select(*out)


def row_cap(df: DataFrame, n: int | None = None) -> DataFrame:
    """Optional first-n rows (the original capped CSV/TSV at 50,000).  Off by default."""
    return df if n is None else df.limit(n)


def drop_junk_columns(df: DataFrame) -> DataFrame:
    """Drop index-like columns named ``Unnamed...`` or ``__...`` (metadata only)."""
    return df.select(*[col_(c) for c in df.columns if not JUNK_COLUMN.match(c)])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Keep columns with fewer nulls than rows (one aggregate for all columns)."""
    if not df.columns:
        return df
    seen = aggregate_in_groups(df, {c: F.count(col_(c)) for c in df.columns})
    return df.select(*[col_(c) for c in df.columns if seen[c]])


def try_cast_numeric(df: DataFrame) -> DataFrame:
    """A column becomes double only if the cast adds no nulls (one aggregate)."""
    if not df.columns:
        return df
    checks = {}
    for c in df.columns:
        v = col_(c)
        x = v.cast("double") if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)) \
            else F.when(v.cast("string").rlike(DECIMAL_TEXT), v.cast("string").cast("double"))
        checks[c] = F.count(x) == F.count(v)
    row = aggregate_in_groups(df, checks)
    out = []
    for c in df.columns:
        v = col_(c)
        if row[c]:
            dt = df.schema[c].dataType
            out.append((v.cast("double") if isinstance(dt, (T.NumericType, T.BooleanType))
                        else F.when(v.rlike(DECIMAL_TEXT), v.cast("double"))).alias(c))
        else:
            out.append(v)
    return df.select(*out)


def ensure_not_empty(df: DataFrame) -> DataFrame:
    """An empty input is an error (one cheap ``isEmpty`` probe)."""
    if df.isEmpty():
        raise ValueError("The uploaded table has no rows.")
    return df


def read_upload(spark: SparkSession, path: str, fmt: str | None = None, record_field: str | None = None,
                encoding: str | None = None, multiline: bool = True) -> DataFrame:
    """The whole upload path: read by extension, drop junk and empty columns; no rows is an error.

    CSV and TSV files that are not UTF-8 are read as latin-1, each by itself, unless ``encoding`` names one for all.
    """
    ext = (fmt or (path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "csv"))
    if ext == "tsv":
        df = read_tsv(spark, path, encoding, multiline=multiline)
    elif ext == "json":
        df = read_json_records(spark, path, record_field, multiline)
    elif ext == "parquet":
        df = spark.read.parquet(path)
    else:
        df = read_csv(spark, path, encoding=encoding, multiline=multiline)
    return drop_all_null_columns(drop_junk_columns(ensure_not_empty(df)))
