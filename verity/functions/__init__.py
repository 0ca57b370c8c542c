"""Scalar column expressions (all JVM-side, no Python UDFs)."""

from .dates import date_shape, parse_as, parse_first
from .email import is_valid_email, normalise_email
from .numeric import (castable_float, decimal_value, is_decimal_text, is_py_float,
                      py_float_value, py_repr_double)
from .ratings import closest_rating_label, is_rating_word, rating_word_number
from .roles import column_role, roles_for
from .text import (has_edge_whitespace, is_lower_style, is_title_style, is_upper_style,
                   smart_title, strip, words)

__all__ = [
    "date_shape", "parse_as", "parse_first", "is_valid_email", "normalise_email",
    "castable_float", "decimal_value", "is_decimal_text", "is_py_float", "py_float_value",
    "py_repr_double", "closest_rating_label", "is_rating_word", "rating_word_number",
    "column_role", "roles_for", "has_edge_whitespace", "is_lower_style", "is_title_style",
    "is_upper_style", "smart_title", "strip", "words",
]
