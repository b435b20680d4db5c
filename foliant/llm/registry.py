"""Queries of the corpus operators and their SQL. Importing it imports all of them, so that whoever imports it knows at once if one can't be."""

from __future__ import annotations

from foliant.llm import decontaminate, importance, licenses, near_dup, packing, pii, quality_lm, secrets, token_files, url_reputation

MODULES = (packing, secrets, pii, quality_lm, near_dup, decontaminate, token_files, licenses, url_reputation, importance)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
