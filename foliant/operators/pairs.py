"""Preference pairs from ranked candidates, and from teacher and student cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.gates import card_gate
from foliant.functions.text import user_turn
from foliant.functions.verdicts import rank_scores
from foliant.operators.assemble import answers, message
from foliant.operators.rows import once

MARGIN = 2.0


def pair_reason(candidates: Column, scores: Column, margin: float = MARGIN) -> Column:
    """Why a ranked document gives no pair: parse, margin or malformed (best or worst is no card); null if it gives one."""
    parse = scores.isNull() | candidates.isNull() | (F.size(scores) != F.size(candidates)) | (F.size(scores) == 0) | F.exists(scores, lambda s: s.isNull())
    best, worst = best_worst(candidates, scores)
    gap = F.array_max(scores) - F.array_min(scores)
    return F.when(F.coalesce(parse, F.lit(True)), "parse").when(gap < margin, "margin").when(card_gate(best).isNull() | card_gate(worst).isNull(), "malformed")


def best_worst(candidates: Column, scores: Column) -> tuple[Column, Column]:
    """Highest and lowest scored candidate; of ties the first."""
    at = lambda v: (F.array_position(scores, v) - 1).cast("int")
    return F.get(candidates, at(F.array_max(scores))), F.get(candidates, at(F.array_min(scores)))


def ranked_pairs(df: DataFrame, margin: float = MARGIN) -> DataFrame:
    """i, reason, chosen, rejected, gap of rows with candidates and scores; the last three are null where there is a reason."""
    best, worst = best_worst(F.col("candidates"), F.col("scores"))
    df = once(df, reason=pair_reason(F.col("candidates"), F.col("scores"), margin))
    some = F.col("reason").isNull()
    return df.select("i", "reason", F.when(some, best).alias("chosen"), F.when(some, worst).alias("rejected"), F.when(some, F.array_max("scores") - F.array_min("scores")).cast("double").alias("gap"))


def judged_candidates(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """i, candidates, scores of a ranking judge's responses; a response whose candidates aren't known has none."""
    ranked = answers(responses).select("i", rank_scores(F.col("content")).alias("scores"))
    return ranked.join(candidates.select("i", "candidates"), "i", "left")


def preference_rows(pairs: DataFrame, manifest: DataFrame, system: Column) -> DataFrame:
    """prompt, chosen, rejected (messages), i and gap of the pairs that have no reason, with the manifest's text."""
    rows = pairs.where(F.col("reason").isNull()).join(manifest.select("i", "text"), "i")
    said = lambda c: F.array(message("assistant", F.col(c))).alias(c)
    return rows.select(F.array(message("system", system), message("user", user_turn(F.col("text")))).alias("prompt"), said("chosen"), said("rejected"), "i", "gap")


def distinct_enough(candidates: Column) -> Column:
    return F.size(F.array_distinct(candidates)) >= 2


def teacher_student_reason(teacher: Column, student: Column, gt: Column, gs: Column, has_student: Column, slack: float = 0.05) -> Column:
    """Why a document gives no pair: missing, malformed, identical or evidence; gt and gs are groundings."""
    same = teacher.eqNullSafe(student)
    return F.when(~has_student, "missing").when(teacher.isNull(), "malformed").when(same, "identical").when(gs > gt + slack, "evidence")


def capped(df: DataFrame, position: str, cap: int = 3000) -> DataFrame:
    """The first pairs in the teacher file's order."""
    return df.orderBy(position).limit(cap)
