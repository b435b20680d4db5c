"""Operator 2, quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Tokens (runs of letters and digits, or of other marks, in lower case) and pairs of them are hashed into `buckets` counters; one multinomial is counted over the text of all
trusted labelled documents (quality 1, not toxic), one over the raw corpus, both with one added to each counter. A document's
ratio is the mean over its n-grams of log(trusted share / raw share), and it is kept if that is at least `least` and the base
rules pass. All documents are counted and all are judged by the same fixed threshold.

Counting is a scan with partial aggregation into at most `buckets` rows for each task; the weights, `buckets` numbers, are the
value of a subquery, so that judging is one more scan without a shuffle and nothing passes through the driver's Python. Ids of
trusted documents are broadcast behind a check of their number; beyond it the raw corpus is still counted without a join, and
only the trusted part is joined, by a shuffle.

Base counts, for the words `[^ \\t-\\r]+` of the whole text: word_chars, n_symbols (of `#*$%&|<>`), n_dup_lines (lines with a
word that equal an earlier line), n_repeat_words (words in windows of three that occur twice or more in the text).
base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words.

Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio (null without words).
Defined results: a null text has no words, as an empty one, and fails the base rules; a null id is judged as any other;
repeated rows each give a row; without trusted documents every ratio is judged against the raw corpus alone and is 0; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import MAX_BROADCAST_ROWS, SPACES, let, table, words

LINE_WITH_WORD = r"[^\x20\x09-\x0D]"


def repeat_words(ws: Column) -> Column:
    """Words in windows of three words that occur twice or more: windows sorted by hash and place, then their places joined."""
    windows = F.when(F.size(ws) > 3, F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("at"))))

    def places(w: Column) -> Column:
        again = lambda x, i: (x["h"] == F.get(w, i - 1)["h"]) | (x["h"] == F.get(w, i + 1)["h"])
        return F.sort_array(F.transform(F.filter(w, lambda x, i: F.coalesce(x["h"] == F.get(w, i - 1)["h"], F.lit(False)) | F.coalesce(again(x, i), F.lit(False))), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")))["n"]

    return F.coalesce(let(F.sort_array(windows), lambda w: let(places(w), covered)), F.lit(0).cast("long"))


def base(text: Column, ws: Column) -> Column:
    """Struct of the base counts."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda s: s.rlike(LINE_WITH_WORD))
    return F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.regexp_replace(full, SPACES + "+", "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.regexp_replace(full, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(ws).alias("n_repeat_words"),
    )


def features(ws: Column, buckets: int) -> Column:
    """Buckets of the tokens and pairs of tokens."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets).cast("long")).cast("int")
    pairs = F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: bucket(F.get(ws, i), F.get(ws, i + 1))))
    return F.concat(F.transform(ws, lambda w: bucket(w)), F.coalesce(pairs, F.array().cast("array<int>")))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, and runs of other marks, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))


def weights(docs: DataFrame, trusted: DataFrame, buckets: int) -> Column:
    """log(trusted share / raw share) of each bucket, an array in one row; trusted has distinct doc_id."""
    grams = F.explode(let(tokens(F.col("text")), lambda ws: features(ws, buckets))).alias("bucket")
    docs = docs.select("doc_id", "text")
    if trusted.count() <= MAX_BROADCAST_ROWS:  # one scan counts both
        flagged = docs.join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
        counts = flagged.select("good", grams).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good"))
    else:  # the raw corpus is counted where it lies; only the trusted part meets its ids
        raw = docs.select(grams).groupBy("bucket").agg(F.count("*").alias("raw"))
        counts = raw.join(docs.join(trusted, "doc_id", "left_semi").select(grams).groupBy("bucket").agg(F.count("*").alias("good")), "bucket", "left")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "good"])
    one = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("all"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))  # `buckets` structs
    share = lambda x, k: (x[k] + 1) / (F.col(k) + buckets)
    return one.select(F.transform("all", lambda x: F.when(F.col("good") == 0, 0.0).otherwise(F.log(share(x, "good")) - F.log(share(x, "raw"))))).scalar()


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 10_000, least: float = -0.25) -> DataFrame:
    """One row for each document, as above."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    docs = docs.select("doc_id", "text", weights(docs, trusted, buckets).alias("weight"))
    ratio = let(let(tokens(F.col("text")), lambda ws: features(ws, buckets)), lambda g: F.try_divide(F.aggregate(g, F.lit(0.0), lambda acc, k: acc + F.get(F.col("weight"), k)), F.size(g)))
    counts = let(words(F.col("text")), lambda ws: base(F.col("text"), ws))
    out = docs.select("doc_id", counts.alias("b"), ratio.alias("ratio"))
    failed = (F.col("b.n_words") < 50) | (100 * F.col("b.n_repeat_words") > 50 * F.col("b.n_words"))
    return out.select("doc_id", "b.*", failed.alias("base_failed"), (~failed & F.coalesce(F.col("ratio") >= least, F.lit(False))).alias("kept"), "ratio")


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_importance": op2_importance}
SQL: dict[str, str] = {}
