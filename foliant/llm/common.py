"""Helpers that the corpus operators share: tables, the shared folder, size-checked joins, Arrow maps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as a Java pattern: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]"
#: Rows of a two-column join side that may be broadcast (about 64 MB as a hash relation); beyond it both sides are shuffled.
MAX_BROADCAST_ROWS = 1_000_000
#: Bytes of text that a Python worker handles at a time; one longer text is a batch of its own.
BATCH_BYTES = 1_000_000
#: Rows and bytes that Spark sends to a Python worker at a time, at most.
SENT_ROWS, SENT_BYTES = 2_000, 4_000_000

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a temporary folder only where that is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base := "file://" + tempfile.mkdtemp(prefix="foliant-"))
    return f"{base}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and outlives executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= max_rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """array<string> of the words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), lambda w: w != "")


def digest(text: Column) -> Column:
    """128 bits of SHA-256 of a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of `column` or a single row."""
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(size):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(size) > start:
            yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= SENT_ROWS:
        spark.conf.set(rows, SENT_ROWS)
    if not spark.conf.get(size).removesuffix("b").isdigit() or int(spark.conf.get(size).removesuffix("b")) > SENT_BYTES:
        spark.conf.set(size, SENT_BYTES)


def trimmed(result: T = None) -> T:
    """result, after this process has given memory that it has freed back to the system.

    Spark keeps Python workers for later tasks; several wait beside those that run, and each would hold the most that it ever had."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
    return result


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, column: str = "text", limit: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow of make()'s function, which turns a batch into columns; make() runs once in each task.

    So that executors stay within their memory, the session's Arrow batches are made smaller where they are larger than SENT_ROWS or SENT_BYTES."""
    small_batches(df.sparkSession)

    def run(batches):
        f = make()
        try:
            for batch in slices(batches, column, limit):
                if batch.num_rows and (out := f(batch)) is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=target)
        finally:
            f = batch = out = None
            trimmed()

    target = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)

