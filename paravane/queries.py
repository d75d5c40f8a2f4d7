"""Registry of the engine's own queries and their DuckDB equivalents."""

from __future__ import annotations

from paravane.plans import q_figures, q_more, q_rows, q_stored


def queries() -> dict:
    return q_figures.QUERIES | q_rows.QUERIES | q_more.QUERIES | q_stored.QUERIES


def oracle_sql() -> dict[str, str]:
    return q_figures.SQL | q_rows.SQL | q_more.SQL | q_stored.SQL
