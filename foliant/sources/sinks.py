"""Sinks: JSON Lines, split and appended outputs, one-document JSON, standard output, text reports."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, *order: str) -> None:
    """Overwrites; sorted by the given columns only here, at the edge."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_split(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """One row as one JSON text."""
    df.select(F.to_json(F.struct("*"))).coalesce(1).write.mode("overwrite").text(path)


def print_json_lines(df: DataFrame, out=None) -> int:
    """Each row as a line, flushed, without gathering the rows; how many there were."""
    out, n = out or sys.stdout, 0
    for line in df.toJSON().toLocalIterator():
        print(line, file=out, flush=True)
        n += 1
    return n


def report(df: DataFrame, width: int = 10, most: int = 1000) -> str:
    """A result of at most `most` rows as a table of fixed width; a longer one is an error, not cut."""
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return "\n".join(" ".join(f"{v:>{width}}" for v in r) for r in [df.columns, *[[show(v) for v in r] for r in found]])
