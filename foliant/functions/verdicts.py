"""Verdicts of judges: grades, counts, truth values and scores from an answer's JSON. A struct<failed, ...>; the rest is null where it failed.

An answer fails where the JSON is missing or broken, a key that must be there is not, or a value is of a type that has no
such reading; grades outside the closed set are left out, and counts are kept within their bounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.gates import kind, strict_json
from foliant.functions.text import clamp, judge_json, let

#: Grades of a subject or topic (fixed values).
GRADES = ["precise", "vague", "wrong"]
FACETS = ["type", "audience", "time", "purpose"]


def truth(v: Column) -> Column:
    """Truth of a JSON value: empty text, zero, null and empty lists and objects are false, any other text true, "false" included."""

    def of(k: Column) -> Column:
        as_ = lambda t: F.try_variant_get(v, "$", t)
        value = F.when(k == "BOOLEAN", as_("boolean")).when(k == "STRING", as_("string") != "").when(k == "VOID", False)
        value = value.when(k.startswith("ARRAY"), F.try_variant_get(v, "$[0]", "variant").isNotNull()).when(k.startswith("OBJECT"), k != "OBJECT<>")
        return F.coalesce(value.otherwise(as_("double") != 0), F.lit(False))

    return let(F.schema_of_variant(v), of)


def whole(v: Column, path: str) -> Column:
    """The number at the path, cut to a whole one; texts of digits and truth values count; null for anything else."""

    def of(k: Column) -> Column:
        text = F.trim(F.try_variant_get(v, path, "string"))
        number = F.when(k == "BIGINT", F.try_variant_get(v, path, "bigint")).when(k == "BOOLEAN", F.try_variant_get(v, path, "boolean").cast("bigint"))
        number = number.when(k == "STRING", F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint")))
        return number.when(k.rlike("^(DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double").try_cast("bigint"))

    return let(kind(v, path), of)


def real(v: Column) -> Column:
    """A list's item as a number; texts that are numbers and truth values count; null for anything else."""

    def of(k: Column) -> Column:
        text = F.trim(F.try_variant_get(v, "$", "string"))
        number = F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(k == "STRING", text.try_cast("double"))
        return number.when(k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))

    return let(F.schema_of_variant(v), of)


def _items(v: Column, path: str) -> Column:
    """array<variant>; null if it is no list."""
    return F.when(kind(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def grades(v: Column, path: str) -> Column:
    """The known grades of a list; null if it is no list."""
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    return F.filter(F.transform(_items(v, path), text), lambda g: g.isin(GRADES))


def _verdict(content: Column, build) -> Column:
    """build gives the fields, and those of them that must not be null."""

    def of(v: Column) -> Column:
        fields, needed = build(v)

        def checked(x: Column) -> Column:
            failed = v.isNull()
            for k in needed:
                failed = failed | x[k].isNull()
            return F.struct(failed.alias("failed"), *[F.when(~failed, x[k]).alias(k) for k in fields])

        return let(F.struct(*[c.alias(k) for k, c in fields.items()]), checked)

    return let(strict_json(judge_json(content)), of)


def facet_verdict(content: Column) -> Column:
    """failed, grades, missed, facet_ok (type, audience, time, purpose), flags_ok, redundant."""

    def build(v: Column):
        absent = lambda k: kind(v, k).isNull()
        oks = F.array(*[F.coalesce(truth(F.try_variant_get(v, f"$.facet_ok.{k}", "variant")), F.lit(False)) for k in FACETS])
        flags = F.when(absent("$.flags_ok"), F.array().cast("array<boolean>")).otherwise(F.transform(_items(v, "$.flags_ok"), truth))
        redundant = F.when(absent("$.redundant_pairs"), F.lit(0)).otherwise(clamp(whole(v, "$.redundant_pairs"), None))
        fields = {"grades": grades(v, "$.subject_grades"), "missed": clamp(whole(v, "$.missed")), "facet_ok": F.when(kind(v, "$.facet_ok").startswith("OBJECT"), oks), "flags_ok": flags, "redundant": redundant}
        return fields, list(fields)

    return _verdict(content, build)


def topic_verdict(content: Column) -> Column:
    """failed, grades, missed, tags_apt."""

    def build(v: Column):
        fields = {"grades": grades(v, "$.topic_grades"), "missed": clamp(whole(v, "$.missed")), "tags_apt": clamp(whole(v, "$.tags_apt"), None)}
        return fields, list(fields)

    return _verdict(content, build)


def match_verdict(content: Column) -> Column:
    """failed, topic_matches, tag_matches."""

    def build(v: Column):
        fields = {k: whole(v, f"$.{k}").cast("int") for k in ("topic_matches", "tag_matches")}
        return fields, list(fields)

    return _verdict(content, build)


def rank_scores(content: Column) -> Column:
    """The scores of an answer; null if there is no list of numbers."""
    scores = let(strict_json(judge_json(content)), lambda v: F.transform(_items(v, "$.scores"), real))
    return let(scores, lambda s: F.when(~F.exists(s, lambda x: x.isNull()), s))
