"""Numeric text recognition and number formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, strip

# Text a columnar float cast accepts: plain decimal with optional exponent.
# nan/inf spellings are treated as non-numeric (stated deviation).
DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Text Python's float() accepts after strip: digits may be grouped by single
# underscores; nan / inf / infinity in any case.
_D = r"[0-9](_?[0-9])*"
PY_FLOAT_TEXT = (r"^[+-]?((" + _D + r")(\.(" + _D + r")?)?|\.(" + _D + r"))([eE][+-]?" + _D + r")?$"
                 r"|^(?i)[+-]?(inf|infinity|nan)$")


def is_decimal_text(c) -> Column:
    """Would a strict columnar cast of this text to double succeed?"""
    return col_(c).rlike(DECIMAL_TEXT)


def decimal_value(c) -> Column:
    """Double value of text guarded by :func:`is_decimal_text`, else null."""
    c = col_(c)
    return F.when(c.rlike(DECIMAL_TEXT), c.cast("double"))


def is_py_float(c) -> Column:
    """Python ``float(text)`` succeeds (text already stripped)."""
    return col_(c).rlike(PY_FLOAT_TEXT)


def py_float_value(c) -> Column:
    c = col_(c)
    return F.when(c.rlike(PY_FLOAT_TEXT), F.regexp_replace(c, "_", "").cast("double"))


def castable_float(c) -> Column:
    """``float(v.strip().replace(',', ''))`` succeeds."""
    return F.coalesce(is_py_float(F.regexp_replace(strip(c), ",", "")), F.lit(False))


def py_repr_double(c) -> Column:
    """Text of a double the way Python's ``str(float)`` writes it."""
    x = col_(c)
    ax = F.abs(x)
    sci = (ax >= F.lit(1e16)) | ((ax < F.lit(1e-4)) & (ax > 0))
    plain_small = x.cast("string")  # Java prints plain decimals in [1e-3, 1e7)
    # outside that band go through a decimal, then trim trailing zeros
    via_dec = F.regexp_replace(
        F.regexp_replace(x.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    java_plain = (ax >= F.lit(1e-3)) & (ax < F.lit(1e7))
    # scientific: Java 1.0E16 -> Python 1e+16 ; 1.5E-5 -> 1.5e-05
    js = x.cast("string")
    mant = F.regexp_replace(F.regexp_extract(js, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    expo = F.regexp_extract(js, r"E(-?[0-9]+)$", 1).cast("int")
    sci_txt = F.concat(mant, F.lit("e"), F.when(expo < 0, "-").otherwise("+"),
                       F.lpad(F.abs(expo).cast("string"), 2, "0"))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .when(x == 0, F.when(x.cast("string").startswith("-"), "-0.0").otherwise("0.0"))
            .when(sci, sci_txt)
            .when(java_plain, plain_small)
            .otherwise(via_dec))
