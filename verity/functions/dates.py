"""Date text shapes (R2) and parsing into ISO text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DATE_FORMATS
from .text import col_

# FIXED VALUES: what strptime reads for each directive.
DIRECTIVES = {"Y": r"([0-9]{4})", "m": r"(1[0-2]|0[1-9]|[1-9])", "d": r"(3[0-1]|[1-2][0-9]|0[1-9]|[1-9]| [1-9])"}


def date_shape(c) -> Column:
    """Index (0-4) of the first date shape the text matches, else null."""
    v = col_(c)
    out = None
    for i, (rx, _py, _sp) in enumerate(DATE_FORMATS):
        cond = v.rlike(rx)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def parse_as(c, fmt_index: int) -> Column:
    """ISO text of the value read with one of the five formats, else null.

    The text must be what strptime takes: four digits of the year, one or two of month and day (a day may
    have a space for its first), the separators, nothing else; and the day must exist.
    """
    v, fmt = col_(c), DATE_FORMATS[fmt_index][1]
    letters = re.findall("%(.)", fmt)
    pattern = "^" + re.sub("%(.)", lambda m: DIRECTIVES[m[1]], fmt.replace(".", r"\.")) + "$"
    part = {x: F.regexp_extract(v, pattern, i + 1) for i, x in enumerate(letters)}
    iso = F.concat(part["Y"], F.lit("-"), F.lpad(part["m"], 2, "0"), F.lit("-"), F.lpad(F.trim(part["d"]), 2, "0"))
    ok = v.rlike(pattern) & (part["Y"] != "0000")
    return F.when(ok, F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))


def parse_first(c, order) -> Column:
    """ISO text from the first format in ``order`` that reads the value."""
    return F.coalesce(*[parse_as(c, i) for i in order])
