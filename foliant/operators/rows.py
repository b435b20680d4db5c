"""Rows whose costly columns are evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, evaluated once for each row: Spark writes a column's expression again into every filter over it, which it doesn't beyond a generator."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
