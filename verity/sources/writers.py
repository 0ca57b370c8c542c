"""Sinks (S9, S11-S14): records, CSV / TSV / JSON export, export variants."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import py_repr_double
from ..functions.text import col_
from .readers import try_cast_numeric

KEEP_NULLS = {"ignoreNullFields": "false"}
INTERNAL = ("_row_id", "_issue_reason")


def to_records(df: DataFrame) -> DataFrame:
    """Cells as text, the way the JSON response prints them.

    null, NaN and +-inf become ""; nested values JSON text (null fields kept).  Column-wise, no collect.
    """
    out = []
    for f in df.schema.fields:
        c, dt = col_(f.name), f.dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            v = F.when(_finite(c), py_repr_double(c.cast("double"))).otherwise(F.lit(""))
        elif isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
            v = F.coalesce(F.to_json(c, KEEP_NULLS), F.lit(""))
        elif isinstance(dt, T.BooleanType):
            v = F.when(c.isNull(), "").when(c, "True").otherwise("False")
        else:
            v = F.coalesce(c.cast("string"), F.lit(""))
        out.append(v.alias(f.name))
    return df.select(*out)


def _finite(c):
    x = c.cast("double")
    return c.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _json_text(c):
    """A text as a JSON string (null: "")."""
    whole = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    return F.substring(whole, 6, 1 << 30).substr(F.lit(1), F.length(whole) - 6)


def to_json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON object: numbers and booleans stay what they are, missing cells are ""."""
    parts = []
    for f in df.schema.fields:
        c, dt = col_(f.name), f.dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            v = F.when(_finite(c), py_repr_double(c.cast("double"))).otherwise(F.lit('""'))
        elif isinstance(dt, (T.NumericType, T.BooleanType)):
            v = F.coalesce(c.cast("string"), F.lit('""'))
        elif isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
            v = _json_text(F.to_json(c, KEEP_NULLS))
        else:
            v = _json_text(c.cast("string"))
        parts.append(F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), v))
    return df.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias(name))


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(col_(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text cells, missing as "", with header.  (The UTF-8 byte-order mark of
    a browser download has no meaning for part files and is not written.)"""
    (_text(df).write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').csv(path))


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated."""
    (_text(df).write.mode(mode).option("header", True).option("sep", "\t")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("quote", '"').option("escape", '"').csv(path))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Numeric-looking columns become numbers, then JSON Lines (null fields kept)."""
    try_cast_numeric(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def export_variant(clean: DataFrame, quarantine: DataFrame, which: str = "full") -> DataFrame:
    """``clean``, ``quarantine`` (internal columns removed) or ``full`` = both."""
    q = quarantine.drop(*[c for c in INTERNAL if c in quarantine.columns])
    c = clean.drop(*[x for x in INTERNAL if x in clean.columns])
    if which == "clean":
        return c
    if which == "quarantine":
        return q
    return c.unionByName(q, allowMissingColumns=True)
