"""Vocabulary and corpus statistics over cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foliant.functions.text import toks
from foliant.operators.rows import once


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return counts(df, column).orderBy(F.desc("n"), column).limit(k)


def subject_frequency(cards: DataFrame, k: int = 10) -> DataFrame:
    return top(cards.select(F.explode("subject").alias("subject")), "subject", k)


def flag_frequency(cards: DataFrame, k: int = 10) -> DataFrame:
    return top(cards.select(F.explode("content_flags").alias("flag")), "flag", k)


def reject_histogram(gated: DataFrame, k: int = 12) -> DataFrame:
    return top(once(gated.select("reason"), reason=F.col("reason")).where(F.col("reason").isNotNull()), "reason", k)


def yields(gated: DataFrame) -> DataFrame:
    """One row: survivors, rejects and the share of survivors, of rows with ok."""
    ok = F.count_if("ok")
    return gated.agg(ok.alias("survivors"), F.count_if(~F.col("ok")).alias("rejects"), F.coalesce(F.try_divide(ok.cast("double"), F.count("*")), F.lit(0.0)).alias("yield"))


def observed(gated: DataFrame, observation: Observation) -> DataFrame:
    """gated as it is, whose survivors and rejects are counted as it is written, without a pass of their own."""
    return gated.observe(observation, F.count_if("ok").alias("survivors"), F.count_if(~F.col("ok")).alias("rejects"))


def null_facets(cards: DataFrame, facets=("type", "audience", "time", "purpose")) -> DataFrame:
    return cards.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in facets])


def token_frequency(cards: DataFrame) -> DataFrame:
    """token, n: number of terms that hold the token, each term once."""
    terms = cards.select(F.explode("subject").alias("term"))
    return counts(terms.select(F.explode(F.array_distinct(toks(F.col("term")))).alias("token")), "token")


def generic_tokens(cards: DataFrame, k: int = 25) -> DataFrame:
    """The k most frequent tokens; ties by token."""
    return token_frequency(cards).orderBy(F.desc("n"), "token").limit(k)


def facet_vocabulary(cards: DataFrame, least: int = 2) -> DataFrame:
    """facet, value, n of type, audience and purpose values that occur often enough."""
    stacked = cards.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("type", "audience", "purpose")])).alias("x")).select("x.*")
    return counts(stacked.where("value is not null"), "facet", "value").where(F.col("n") >= least)


def totals(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("subject")), F.lit(0)).cast("long").alias("n_subject_terms"))


def vocabulary_document(cards: DataFrame) -> DataFrame:
    """One row `json` with token counts, generic tokens, facet values and totals; the vocabulary, not the corpus, is gathered."""
    tokens = token_frequency(cards).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "n")))).alias("subject_tokens"))
    generic = generic_tokens(cards).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "token"))), lambda x: x["token"]).alias("generic_tokens"))
    facets = facet_vocabulary(cards).groupBy("facet").agg(F.array_sort(F.collect_list("value")).alias("values")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("facet", "values")))).alias("facet_vocab"))
    one = tokens.withColumn("k", F.lit(1))
    for part in (generic, facets, totals(cards)):
        one = one.join(part.withColumn("k", F.lit(1)), "k")
    return one.select(F.to_json(F.struct("subject_tokens", "generic_tokens", "facet_vocab", "n_subject_terms", "n_docs")).alias("json"))
