"""All queries of the core: name to plan, and name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from lectern.plans import catalogs, documents, extracts, increments, searches

FLAGSHIP = "ft_search_word"
_MODULES = [searches, catalogs, documents, extracts, increments]


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.SQL
    return out
