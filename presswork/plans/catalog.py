"""All queries of the library's own operators."""

from __future__ import annotations

from presswork.plans import figures, landed, merge, monitor, search, text

MODULES = (figures, merge, search, text, monitor, landed)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.R.sql.items()}
