"""Readers: JSON Lines (plain or gzip), JSON documents, text files, standard input, and text extraction by register."""

from __future__ import annotations

import ast
import json
import sys
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.functions.text import strip

#: Schema of raw documents of any register; issue and comments stay JSON text or a Python literal.
RAW = "id string, text string, body_text string, text_sha256 string, raw_issue string, raw_comments string"
COMMENTS = 6


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; gzip by its suffix; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def plain_or_gzip(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return json_lines(spark, path if exists(spark, path) else f"{path}.gz", schema)


def json_lines_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """No rows where the file is missing, as for a batch that isn't completed or statistics that weren't made."""
    return json_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def prompt_text(spark: SparkSession, path: str) -> Column:
    """The text of one file as a literal."""
    return F.lit(spark.read.text(path, wholetext=True).head()[0])


def text_files(spark: SparkSession, pattern: str, limit: int = 0) -> DataFrame:
    """name and text of each file, by path; the first `limit` if it isn't 0."""
    df = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    return df.orderBy("name").limit(limit) if limit else df


def text_file(spark: SparkSession, path: str) -> DataFrame:
    return text_files(spark, path)


def standard_input(spark: SparkSession, stream=None) -> DataFrame:
    """One document `<stdin>`, or none if it is blank."""
    text = (stream or sys.stdin).read()
    return spark.createDataFrame([("<stdin>", text)] if text.strip() else [], "name string, text string")


def dataset(df: DataFrame, name: str, position: str, field: str = "text", limit: int = 0, least: int = 200) -> DataFrame:
    """name and text of a table's field; the limit counts scanned rows, and shorter stripped texts are dropped after it."""
    df = df.where(F.col(position) < limit) if limit else df
    return df.where(F.length(strip(F.col(field))) > least).select(F.concat(F.lit(f"{name}#"), F.col(position).cast("string")).alias("name"), F.col(field).alias("text"))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@F.pandas_udf(StringType())
def literal_to_json(values: pd.Series) -> pd.Series:
    """JSON of a JSON text or a Python literal; null if it is neither."""

    def one(v):
        if v is None:
            return None
        for parse in (json.loads, ast.literal_eval):
            try:
                found = parse(v)
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                continue
            return json.dumps(found, default=str) if isinstance(found, (dict, list)) else None
        return None

    return values.map(one)


def ticket_text(issue_json: Column, comments_json: Column, literals: bool = False) -> Column:
    """Summary, description and the first six comments, blanks left out after the cut to six.

    With `literals` the two may be Python literals too, which costs a pass through Python for all rows."""
    value = lambda c: F.try_parse_json(F.coalesce(literal_to_json(c), c) if literals else c)
    issue, comments = value(issue_json), value(comments_json)
    text = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    summary = F.when(~blank(text(issue, "$.summary")), F.concat(F.lit("Issue: "), text(issue, "$.summary")))
    first = F.slice(F.coalesce(F.try_variant_get(comments, "$", "array<variant>"), F.array().cast("array<variant>")), 1, COMMENTS)
    bodies = F.transform(first, lambda v: F.when(~blank(text(v, "$.body")), F.concat(F.lit("Comment: "), strip(text(v, "$.body")))))
    parts = F.concat(F.array(summary, F.when(~blank(text(issue, "$.description")), strip(text(issue, "$.description")))), bodies)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n")


def register_text(register: Column, text: Column, body_text: Column, ticket: Column) -> Column:
    """Text of a document by its register; missing is empty."""
    return F.coalesce(F.when(register == "chat", body_text).when(register == "ticket", ticket).otherwise(text), F.lit(""))


def fingerprint(text_sha256: Column, id_: Column, record: Column) -> Column:
    """The first that is given of digest and id, else a digest of the record's JSON with sorted keys."""
    return F.coalesce(F.nullif(text_sha256, F.lit("")), F.nullif(id_, F.lit("")), F.sha2(F.left(record, F.lit(2000)), 256))
