"""E-mail checks and normalisation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DOMAIN_FIXES, EMAIL_PATTERN
from .text import col_, strip


def is_valid_email(c) -> Column:
    return col_(c).rlike(EMAIL_PATTERN)


def normalise_email(c, stripped: bool = False) -> Column:
    """strip + lower; a known misspelt domain after the last '@' is corrected."""
    fixed = F.lower(col_(c) if stripped else strip(c))
    has_at = F.instr(fixed, "@") > 0
    domain = F.substring_index(fixed, "@", -1)
    local = F.left(fixed, F.length(fixed) - F.length(domain) - 1)
    fixes = F.create_map(*[F.lit(x) for x in chain.from_iterable(DOMAIN_FIXES)])
    new_domain = F.coalesce(F.element_at(fixes, domain), domain)
    return F.when(has_at, F.concat(local, F.lit("@"), new_domain)).otherwise(fixed)
