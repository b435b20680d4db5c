"""Registers a query together with its SQL."""

from __future__ import annotations


def declarer(queries: dict, sql: dict):
    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return query
