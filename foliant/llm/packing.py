"""Operator 10, packing: optimal length buckets.

The global histogram of segment lengths is exact over all documents and has at most `max_length` bins, so it fits the driver;
dynamic programming over it chooses the `buckets` upper bounds that minimise padding. Batches of at most `budget` padded
positions then form inside each bucket. A bucket is numbered in shards of about `shard_rows` segments, dealt by hash of id and
segment, so a bucket that holds most of the corpus is never ordered in one task; a shard that turns out more than twice as
large, because ids repeat or are null, is dealt again by row. Each shard ends with at most one batch that isn't full.

Length: words plus one end mark, or any column of integers. A document longer than `max_length` is cut into segments of
`max_length` and a rest; nothing is dropped.

Defined results: a null or empty text is one segment of length 1; a null length counts as 0 and gives a segment of length 1;
a null id is packed as any other; repeated rows are packed as often as they come; an empty table gives no rows; columns
other than the id and the text or length are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliant.llm.common import maybe_broadcast, stored, table, words


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, ascending, of at most `buckets` groups of the ascending distinct lengths with the least total padding."""
    n = len(lengths)
    if n == 0:
        return []
    before = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    best = lengths * before[1:]
    cut = [np.zeros(n, np.int64)]
    for _ in range(min(buckets, n) - 1):
        now, at = np.empty(n), np.zeros(n, np.int64)
        now[0] = best[0]
        for j in range(1, n):
            total = best[:j] + lengths[j] * (before[j + 1] - before[1 : j + 1])
            i = int(np.argmin(total))
            now[j], at[j] = (total[i], i + 1) if total[i] < best[j] else (best[j], -1)
        best, cut = now, [*cut, at]
    bounds, j = [], n - 1
    for at in reversed(cut):
        if at[j] == -1:
            continue
        bounds.append(int(lengths[j]))
        j = int(at[j]) - 1
        if j < 0:
            break
    return bounds[::-1]


def padding(lengths, counts, bounds) -> int:
    """Padded positions that the bounds leave."""
    upper = np.asarray(bounds)[np.searchsorted(bounds, lengths)]
    return int(((upper - lengths) * counts).sum())


def segments(docs: DataFrame, length: Column, id_col: str = "doc_id", max_length: int = 4096) -> DataFrame:
    """Segments of every document: id, segment, start, length."""
    n = F.greatest(F.coalesce(length, F.lit(0)).cast("long"), F.lit(0)) + 1
    cut = docs.select(F.col(id_col).alias("doc_id"), n.alias("n"))
    cut = cut.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_length))).alias("segment"))
    start = F.col("segment") * max_length
    return cut.select("doc_id", "segment", start.alias("start"), F.least(F.lit(max_length).cast("long"), F.col("n") - start).alias("length"))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 16, max_length: int = 4096, budget: int = 65_536, shard_rows: int = 8_192
) -> DataFrame:
    """One row for each segment: doc_id, segment, start, length, bucket, bound, shard, batch, slot."""
    if length is None:
        length = F.size(words(F.col(text_col)))
    cut = stored(segments(docs, length, id_col, max_length).withColumn("row", F.monotonically_increasing_id()), "segments")
    histogram = sorted(tuple(r) for r in cut.groupBy("length").count().collect())  # at most max_length rows
    lengths, counts = (np.array([r[k] for r in histogram], np.int64) for k in (0, 1))
    bounds = optimal_bounds(lengths, counts, buckets) or [max_length]
    held = np.zeros(len(bounds), np.int64)
    np.add.at(held, np.searchsorted(bounds, lengths), counts)
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("length") <= bounds[k], F.lit(k)).otherwise(bucket)
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)
    cut = cut.withColumn("bucket", bucket)
    shards = np.maximum(1, -(-held // shard_rows))
    cut = cut.withColumn("bound", of(bounds)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "segment"), of(shards).cast("long")).cast("int"))
    crowded = cut.groupBy("bucket", "shard").count().where(F.col("count") > 2 * shard_rows).select("bucket", "shard", F.ceil(F.col("count") / shard_rows).alias("parts"))
    cut = cut.join(maybe_broadcast(stored(crowded, "crowded")), ["bucket", "shard"], "left")
    again = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1).cast("long")))
    cut = cut.withColumn("shard", F.col("shard") + (again * of(shards)).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "segment", "length", "row")) - 1
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bound"))).cast("int")
    cut = cut.withColumn("place", place)
    return cut.select("doc_id", "segment", "start", "length", "bucket", "bound", "shard", F.floor(F.col("place") / size).cast("int").alias("batch"), (F.col("place") % size).alias("slot"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
