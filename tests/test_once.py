"""What a row costs: the expression over a document's text stands once in a query's plan, or is behind a stored table."""

import hashlib

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from foliant.functions import hashing
from foliant.operators.rows import once
from foliant.plans import evaluation, fixtures
from foliant.plans.registry import QUERIES

COSTLY = "regexp_extract_all("


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_once_stays_below_filters(spark, whole_plans):
    df = once(spark.range(9).select(F.col("id"), F.lit("a").alias("x")), x=F.concat(F.lit("v"), F.col("id").cast("string")), y=F.sqrt("id"))
    out = df.where("x <> 'v3' and y > 1").select("id", "x", "y")
    assert plan(out).count("SQRT(") == 1
    assert [(r.id, r.x) for r in out.orderBy("id").collect()] == [(k, f"v{k}") for k in range(9) if k > 1 and k != 3]


@pytest.mark.parametrize("m", [1, 2, 97, 100, 2**20 + 7, 2**31 - 1, 2**40 + 15])
def test_hash_mod_of_any_modulus(spark, m):
    rows = spark.range(50).select("id", hashing.hash_mod(hashing.key("k-", F.col("id")), m).alias("m")).collect()
    assert all(r.m == int(hashlib.sha256(f"k-{r.id}".encode()).hexdigest(), 16) % m for r in rows)


@pytest.mark.parametrize("name", ["gap_summary", "ranked_pairs", "rank_prompts", "gate_facet_rejects", "gate_facet_values"])
def test_subjects_are_taken_once(spark, whole_plans, name):
    assert plan(QUERIES[name](spark, DATA)).count(COSTLY) == 1


@pytest.mark.parametrize("name", ["reward_parts", "reward_quartiles", "faith_verdicts", "harvest_survivors"])
def test_subjects_are_stored(spark, whole_plans, name):
    assert COSTLY not in plan(QUERIES[name](spark, DATA))


def test_validated_rewards_read_the_text_once(spark, whole_plans, monkeypatch):
    real, seen = evaluation.stored, {}
    monkeypatch.setattr(evaluation, "stored", lambda df, tag: (seen.update({tag: plan(df).count(COSTLY)}), real(df, tag))[1])
    QUERIES["reward_spearman"](spark, DATA)
    assert seen == {"cards": 1, "validated": 0}


def test_flags_match_as_their_patterns(spark):
    texts = ["", "@", "a@", "a@b", "a@b.", "x .@9.c", "@a.", "a@.b", "my token", "passwor", "copyright", "licens e", "secrets", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select([f(F.col("t"), p) for _, p in fixtures.FLAGS for f in (fixtures.found, lambda t, p: t.rlike(p))])
    assert all(r[k] == r[k + 1] for r in df.collect() for k in range(0, len(r), 2))
