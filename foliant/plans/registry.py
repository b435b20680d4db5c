"""Queries over the fixture tables and their SQL."""

from __future__ import annotations

from foliant.plans import corpus, evaluation, gating, training

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (corpus, gating, training, evaluation):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
