"""R1 column roles: decided from the column name alone (metadata, no data)."""

from __future__ import annotations

from .constants import (CRITICAL_COLS, DATE_COLS, EMAIL_COLS, ID_COLS, NAME_COLS,
                        PHONE_COLS)

ROLES = ("id", "critical", "name", "email", "date", "phone", "generic")


def normalise(name: str) -> str:
    return name.lower().replace(" ", "_").strip()


def column_role(name: str) -> str:
    """Role of a column by name; every role but ``id`` matches on substrings."""
    c = normalise(name)
    if c in ID_COLS or c.endswith("_id"):
        return "id"
    for role, keys in (("critical", CRITICAL_COLS), ("name", NAME_COLS),
                       ("email", EMAIL_COLS), ("date", DATE_COLS), ("phone", PHONE_COLS)):
        if any(k in c for k in keys):
            return role
    return "generic"


def roles_for(columns, overrides: dict | None = None) -> dict[str, str]:
    overrides = overrides or {}
    return {c: overrides.get(c, column_role(c)) for c in columns}
