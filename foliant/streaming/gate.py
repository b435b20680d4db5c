"""Incremental validation: answers arrive as files, are gated, and appended once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_answers(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def gated(answers: DataFrame, gate: Callable[[Column], Column], content: str = "content") -> DataFrame:
    return answers.select("*", gate(F.col(content)).alias("g")).select(*answers.columns, "g.ok", "g.reason", "g.value")


def run_gate(answers: DataFrame, gate: Callable[[Column], Column], survivors: str, rejects: str, checkpoint: str, key: str | None = None) -> StreamingQuery:
    """Gates all files that are there and stops; the checkpoint is the log of what was attempted.

    Each micro-batch writes a folder of its own, so a batch that is run again overwrites what it wrote."""
    stream = gated(answers, gate)
    if key:
        stream = stream.dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("ok").drop("reason").write.mode("overwrite").parquet(f"{survivors}/batch={number}")
        batch.where("not ok").select("*").drop("value").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
