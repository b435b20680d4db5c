"""Evaluation aggregates: set-based scores, facet accuracy, faithfulness roll-ups, rank correlation, quartiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.verdicts import FACETS, GRADES


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1 columns; 0 where undefined."""
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1")]


def set_scores(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row: micro counts over distinct values, scores, and who abstained."""
    empty = F.array().cast("array<string>")
    g, p = (F.array_distinct(F.coalesce(F.col(c), empty)) for c in (gold, pred))
    per = df.select(F.size(F.array_intersect(g, p)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"), (F.size(g) == 0).alias("g0"), (F.size(p) == 0).alias("p0"))
    total = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")], F.count_if("g0").alias("gold_empty"), F.count_if("p0").alias("pred_empty"), F.count_if(F.col("g0") & F.col("p0")).alias("both_empty"), F.count("*").alias("n"))
    return total.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def judged_scores(df: DataFrame, gold: str = "gold", pred: str = "pred", matched: str = "matched") -> DataFrame:
    """One row: micro scores from a judge's match counts, each at most the size of either list; a missing judgement is 0."""
    empty = F.array().cast("array<string>")
    ng, np_ = F.size(F.coalesce(F.col(gold), empty)), F.size(F.coalesce(F.col(pred), empty))
    tp = F.least(F.coalesce(F.col(matched), F.lit(0)), ng, np_)
    s = df.agg(F.sum(tp).cast("long").alias("tp"), F.sum(np_ - tp).cast("long").alias("fp"), F.sum(ng - tp).cast("long").alias("fn"))
    return s.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def facet_accuracy(df: DataFrame, facets: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """facet, n, accuracy over topics that both sides have; of repeated topics the last label counts, null equals null.

    A label may have `keys`, the facets that it names; a facet that either side doesn't name is not counted."""
    last = lambda labels, t: F.element_at(F.filter(labels, lambda l: l["topic"] == t), -1)
    topics = F.array_intersect(F.transform(gold, lambda l: l["topic"]), F.transform(pred, lambda l: l["topic"]))
    agreed = df.select(gold, pred, F.explode(topics).alias("topic"))
    agreed = agreed.select(last(F.col(gold), F.col("topic")).alias("g"), last(F.col(pred), F.col("topic")).alias("p"))
    has = lambda c, side, k: F.array_contains(f"{c}.keys", k) if "keys" in df.schema[side].dataType.elementType.names else F.lit(True)
    named = lambda k: F.coalesce(has("g", gold, k) & has("p", pred, k), F.lit(True))
    rows = F.array(*[F.struct(F.lit(k).alias("facet"), named(k).alias("named"), F.col(f"g.{k}").eqNullSafe(F.col(f"p.{k}")).alias("same")) for k in facets])
    return agreed.select(F.explode(rows).alias("x")).select("x.*").where("named").groupBy("facet").agg(F.count("*").alias("n"), F.avg(F.col("same").cast("double")).alias("accuracy"))


def faithful(grades: Column, missed: Column, oks: Column | None = None, flags: Column | None = None) -> Column:
    """No wrong grade, nothing missed, and, where given, all facets and all flags right."""
    ok = ~F.array_contains(grades, "wrong") & (missed == 0)
    for more in (oks, flags):
        if more is not None:
            ok = ok & F.forall(more, lambda x: x)
    return ok


def _known(c: str = "grades") -> Column:
    """The grades of the closed set."""
    return F.filter(c, lambda g: g.isin(GRADES))


def _shares(good: Column, prefix: str) -> list[Column]:
    of = lambda c: F.sum(F.when(good, c))
    graded = of(F.size(_known()))
    return [_ratio(of(F.size(F.filter("grades", lambda g: g == k))), graded).alias(f"{prefix}_{k}") for k in GRADES]


def facet_rollup(df: DataFrame) -> DataFrame:
    """Roll-up by mode and over ALL of rows with mode, grades, missed, facet_ok (array of 4), flags_ok, redundant, and failed; failures are counted apart."""
    good = ~F.col("failed")
    n = F.count_if(good)
    of = lambda c: F.sum(F.when(good, c))
    facets = [_ratio(F.count_if(good & F.get("facet_ok", F.lit(k))), n).alias(f"{name}_ok") for k, name in enumerate(FACETS)]
    flags = _ratio(of(F.size(F.filter("flags_ok", lambda x: x))), of(F.size("flags_ok"))).alias("flags_ok_rate")
    whole = F.coalesce(good & faithful(F.col("grades"), F.col("missed"), F.col("facet_ok"), F.col("flags_ok")), F.lit(False))
    return df.groupingSets([["mode"], []], "mode").agg(
        F.coalesce("mode", F.lit("ALL")).alias("bucket"), n.alias("docs"), F.count_if("failed").alias("failures"), *_shares(good, "subject"), _ratio(of(F.col("missed")), n).alias("missed_avg"), *facets, flags,
        _ratio(of(F.col("redundant")), n).alias("redundant_avg"), _ratio(F.count_if(whole), n).alias("faithful"),
    ).drop("mode")


def topic_rollup(df: DataFrame) -> DataFrame:
    """Roll-up by mode and over ALL of rows with mode, grades, missed, tags_apt, n_tags, and failed; failures are counted apart."""
    good = ~F.col("failed")
    n = F.count_if(good)
    of = lambda c: F.sum(F.when(good, c))
    whole = F.coalesce(good & faithful(F.col("grades"), F.col("missed")), F.lit(False))
    return df.groupingSets([["mode"], []], "mode").agg(
        F.coalesce("mode", F.lit("ALL")).alias("bucket"), n.alias("docs"), F.count_if("failed").alias("failures"), *_shares(good, "topic"), _ratio(F.count_if(whole), n).alias("faithful"),
        _ratio(of(F.col("missed")), n).alias("missed_avg"), F.try_divide(of(F.col("tags_apt")).cast("double"), of(F.col("n_tags")).cast("double")).alias("tags_apt_rate"),
    ).drop("mode")


def mid_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks from 1, ties at their mean: from counts by value, so that only distinct values are ordered."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = counts.withColumn(out, upto - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(ranks, column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and rank correlation; 0 where a side doesn't vary."""
    ranked = mid_ranks(mid_ranks(df.select(x, y), x, "rx"), y, "ry")
    rho = F.coalesce(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")), F.lit(0.0))
    return ranked.agg(F.count("*").alias("n"), rho.alias("rho"))


def quartiles(df: DataFrame, by: str, tie: str, *aggregates: Column) -> DataFrame:
    """quartile 0 to 3 by rising `by`, each of n div 4 rows and the last with the rest."""
    n = F.count("*").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(by, tie)) - 1
    q = F.least(F.lit(3), F.floor(place / F.greatest(F.lit(1), F.floor(n / 4)))).cast("int")
    return df.withColumn("quartile", q).groupBy("quartile").agg(F.count("*").alias("n"), *aggregates)


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """One row: n, least, upper median and greatest; the median is the element at n div 2 of the ascending values."""
    counts = df.groupBy(column).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("c").over(Window.partitionBy())
    return counts.select(column, upto.alias("u"), total.alias("t")).agg(F.max("t").alias("n"), F.min(column).alias("least"), F.min(F.when(F.col("u") > F.floor(F.col("t") / 2), F.col(column))).alias("median"), F.max(column).alias("greatest"))
