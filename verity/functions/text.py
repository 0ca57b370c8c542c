"""String column expressions: trimming, case styles, title-casing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import NAME_PARTICLES

# Unicode-aware whitespace (Java's (?U) flag turns \s into White_Space).
WS_EDGES = r"(?U)^\s+|\s+$"
WS_RUN = r"(?U)\s+"
WS = r"(?U)\s"
# A string equals its Python str.title() form exactly when no lower-case letter
# starts a word and no upper/title-case letter follows a cased letter.
NOT_TITLE = r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]"


def quoted(name: str) -> str:
    """A column's exact name as Spark parses it (dots and backticks are part of the name)."""
    return "`" + name.replace("`", "``") + "`"


def col_(c) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col_(c), WS_EDGES, "")


def has_edge_whitespace(c) -> Column:
    c = col_(c)
    return c.isNotNull() & (c != strip(c))


def is_lower_style(c) -> Column:
    c = col_(c)
    return (c == F.lower(c)) & (c != F.upper(c))


def is_upper_style(c) -> Column:
    c = col_(c)
    return (c == F.upper(c)) & (c != F.lower(c))


def is_title_style(c) -> Column:
    return ~col_(c).rlike(NOT_TITLE)


def collapse_ws(c) -> Column:
    """Runs of whitespace to one space, ends trimmed: ``" ".join(s.split())``."""
    c = col_(c)
    return F.when(c.rlike(WS), F.regexp_replace(F.regexp_replace(c, WS_RUN, " "), "^ | $", "")).otherwise(c)


def words(c) -> Column:
    """Python ``str.split()``: runs of whitespace, no empty pieces.

    Written without higher-order functions so it stays inside whole-stage codegen.
    """
    t = collapse_ws(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def capitalize(w: Column) -> Column:
    """Python ``str.capitalize`` for one word."""
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def smart_title(c) -> Column:
    """Capitalise each word; name particles stay lower unless first.

    ``initcap`` capitalises space-separated words, so whitespace is collapsed
    first; particles after the first word are then put back to lower case
    (in text that has any).
    """
    title = out = F.initcap(collapse_ws(c))
    for p in NAME_PARTICLES:
        out = F.regexp_replace(out, f"(?<= ){p.capitalize()}(?= |$)", p)
    some = "(?<= )(" + "|".join(p.capitalize() for p in NAME_PARTICLES) + ")(?= |$)"
    return F.when((F.instr(title, " ") > 0) & title.rlike(some), out).otherwise(title)



# --- driver-side twins, used on a handful of scalars (never on rows) --------

def py_style(v: str) -> tuple[bool, bool, bool]:
    """(lower, upper, title) style flags of one value, Python semantics."""
    return (v == v.lower() and v != v.upper(),
            v == v.upper() and v != v.lower(),
            v == v.title())
