"""Rating words to numbers and numbers to rating labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import RATING_LABEL_DEFAULT, RATING_LABELS, RATING_WORDS
from .text import col_


def rating_word_number(c) -> Column:
    """First rating word contained in the lowered text, in scan order -> number text.

    Returns the number as text ("5.0", "3.5", ...) or null when no word hits.
    """
    vl = col_(c)
    out = None
    for word, num in RATING_WORDS:
        cond = F.instr(vl, word) > 0
        out = F.when(cond, F.lit(str(num))) if out is None else out.when(cond, F.lit(str(num)))
    return out


def is_rating_word(c) -> Column:
    """Exact membership of lowered text in the rating vocabulary."""
    return col_(c).isin(*[w for w, _ in RATING_WORDS])


def closest_rating_label(x) -> Column:
    """Nearest rating value's label; a tie goes to the lower value; NaN/inf -> default."""
    x = col_(x)
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    out = None
    for (v0, l0), (v1, _) in zip(RATING_LABELS, RATING_LABELS[1:]):
        cond = x <= F.lit((v0 + v1) / 2)
        out = F.when(cond, F.lit(l0)) if out is None else out.when(cond, F.lit(l0))
    out = out.otherwise(F.lit(RATING_LABELS[-1][1]))
    return F.when(x.isNull(), F.lit(None)).when(~finite, F.lit(RATING_LABEL_DEFAULT)).otherwise(out)
