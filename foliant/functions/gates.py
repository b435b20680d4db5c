"""Validation of model answers: struct<ok, reason, value>, the first failing check giving the reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import body, greedy_json, lazy_json, let, norm, strip, think, word_count

#: Closed ontology (fixed values).
TOPICS = ["compensation", "workforce", "mergers_acquisitions", "financials", "pricing", "legal", "security", "credentials", "product", "strategy", "competition", "personnel", "regulatory", "customer_data"]
FACETS = {
    "scope": ["individual", "group", "aggregate", "org_wide"],
    "publicity": ["public", "internal", "restricted"],
    "temporality": ["historical", "current", "forward_looking"],
    "specificity": ["named", "figures", "both", "general"],
    "register_facet": ["report", "negotiation", "decision", "directive", "request", "mention", "speculation"],
}
#: Closed values of time, and the facets of one value (fixed values).
TIMES = ["historical", "current", "forward_looking"]
SINGLE = ["type", "audience", "time", "purpose"]
LABEL = "struct<topic:string,scope:string,publicity:string,temporality:string,specificity:string,register_facet:string>"
CARD = "struct<subject:array<string>,type:string,audience:string,time:string,purpose:string,content_flags:array<string>>"
FLAT = "struct<topics:array<string>,tags:array<string>>"


def strict_json(text: Column) -> Column:
    """The value as a variant; null if the text isn't exactly one JSON object. Of a repeated key the last counts, which the session is set to allow."""
    if session := SparkSession.getActiveSession():
        session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def one(boxed: Column) -> Column:
        first = F.try_variant_get(boxed, "$[0]", "variant")
        alone = F.try_variant_get(boxed, "$[1]", "variant").isNull()
        return F.when(alone & F.coalesce(F.schema_of_variant(first).startswith("OBJECT"), F.lit(False)), first)

    return let(F.when(text != "", F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))), one)


def kind(v: Column, path: str) -> Column:
    """JSON type at the path as Spark prints it; null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_strings(k: Column) -> Column:
    return k.isin("ARRAY<STRING>", "ARRAY<VOID>")


def _string(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _result(reason: Column, value: Column, thought: Column | None = None) -> Column:
    parts = [reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), value).alias("value")]
    return F.struct(*parts, *([thought.alias("think")] if thought is not None else []))


def _before_json(p: Column, least_words: int):
    return F.when(p["c"].isNull(), "no_response").when(word_count(p["t"]) < least_words, "no_think").when(p["j"] == "", "no_json").when(p["v"].isNull(), "bad_json")


def parsed(content: Column, first_key: str, build: Callable[[Column], Column], reasoning: Column | None = None) -> Column:
    """build over a struct of the content c, its thought t, the JSON text j that opens with the key, and its value v."""
    texts = lambda c: F.struct(c.alias("c"), think(c, reasoning).alias("t"), greedy_json(body(c), first_key).alias("j"))
    return let(let(content, texts), lambda x: let(F.struct(x["c"].alias("c"), x["t"].alias("t"), x["j"].alias("j"), strict_json(x["j"]).alias("v")), build))


def ontology_gate(content: Column, reasoning: Column | None = None, least_words: int = 25) -> Column:
    """Closed-ontology labels: topics before facets for each label, labels in order."""

    def first_fault(l: Column) -> Column:
        topic = _string(l, "$.topic")
        shown = F.coalesce(F.try_variant_get(l, "$.topic", "string"), F.lit("None"))
        fault = F.when(~F.coalesce(F.schema_of_variant(l).startswith("OBJECT"), F.lit(False)), "bad_json")
        fault = fault.when(~F.coalesce(topic.isin(TOPICS), F.lit(False)), F.concat(F.lit("off_topic:"), shown))
        for k, values in FACETS.items():
            got = F.coalesce(F.try_variant_get(l, f"$.{k}", "string"), F.lit("None"))
            fault = fault.when(~F.coalesce(_string(l, f"$.{k}").isin(values), F.lit(False)), F.concat(F.lit(f"off_facet:{k}="), got))
        return fault

    as_struct = lambda l: F.struct(*[F.try_variant_get(l, f"$.{k}", "string").alias(k) for k in ("topic", *FACETS)])

    def build(p: Column) -> Column:
        def checked(labels: Column) -> Column:
            fault = F.get(F.filter(F.transform(labels, first_fault), lambda x: x.isNotNull()), F.lit(0))
            reason = _before_json(p, least_words).when(labels.isNull(), "bad_json").otherwise(fault)
            return let(reason, lambda r: _result(r, F.transform(labels, as_struct), p["t"]))

        return let(F.try_variant_get(p["v"], "$.labels", "array<variant>"), checked)

    return parsed(content, "labels", build, reasoning)


def _terms(v: Column, path: str) -> Column:
    """Normalised distinct terms; null if the value is no list, empty if it is absent or null."""
    empty = F.array().cast("array<string>")
    listed = F.filter(F.transform(F.filter(F.try_variant_get(v, path, "array<string>"), lambda x: strip(F.coalesce(x, F.lit(""))) != ""), norm), lambda x: x != "")
    return let(kind(v, path), lambda k: F.when(k.isNull() | (k == "VOID"), empty).when(k.startswith("ARRAY"), F.array_distinct(listed)))


def openvocab_gate(content: Column, least_words: int = 25) -> Column:
    """Open topics (1 to 6) and tags (1 to 12), counted after normalisation."""

    def build(p: Column) -> Column:
        def checked(x: Column) -> Column:
            topics, tags = x["topics"], x["tags"]
            reason = _before_json(p, least_words).when(topics.isNull() | tags.isNull(), "bad_json")
            reason = reason.when(~F.size(topics).between(1, 6), F.concat(F.lit("topics_count:"), F.size(topics).cast("string")))
            reason = reason.when(~F.size(tags).between(1, 12), F.concat(F.lit("tags_count:"), F.size(tags).cast("string")))
            return let(reason, lambda r: _result(r, x, p["t"]))

        return let(F.struct(_terms(p["v"], "$.topics").alias("topics"), _terms(p["v"], "$.tags").alias("tags")), checked)

    return parsed(content, "topics", build)


def faceted_gate(content: Column, least_words: int = 25, most_flags: int = 4) -> Column:
    """Faceted card: 1 to 3 subjects, single facets text or null, at most `most_flags` flags."""
    empty = F.array().cast("array<string>")
    single = lambda v, k: let(_string(v, f"$.{k}"), lambda s: F.when(strip(s) != "", norm(s)))
    solid = lambda x: strip(F.coalesce(x, F.lit(""))) != ""

    def build(p: Column) -> Column:
        v = p["v"]

        def checked(x: Column) -> Column:
            none = x["flag_kind"].isNull() | (x["flag_kind"] == "VOID")
            reason = _before_json(p, least_words).when(x["subject"].isNull(), "bad_json")
            reason = reason.when(~F.size(x["subject"]).between(1, 3), F.concat(F.lit("subject_count:"), F.size(x["subject"]).cast("string")))
            for k in SINGLE:
                reason = reason.when(~F.coalesce(kind(v, f"$.{k}"), F.lit("VOID")).isin("STRING", "VOID"), f"bad_{k}")
            reason = reason.when(~none & (~x["flag_kind"].startswith("ARRAY") | (F.size(x["flags"]) > most_flags)), "bad_flags")
            kept = F.when(none, empty).otherwise(F.transform(F.filter(x["flags"], solid), norm))
            card = F.struct(x["subject"].alias("subject"), *[single(v, k).alias(k) for k in SINGLE], kept.alias("content_flags"))
            return let(reason, lambda r: _result(r, card, p["t"]))

        parts = F.struct(_terms(v, "$.subject").alias("subject"), kind(v, "$.content_flags").alias("flag_kind"), F.try_variant_get(v, "$.content_flags", "array<string>").alias("flags"))
        return let(parts, checked)

    return parsed(content, "subject", build)


def card_gate(content: Column, most_flags: int = 3) -> Column:
    """The card, or null unless all six keys are present and each is of its type."""

    def build(v: Column) -> Column:
        def checked(x: Column) -> Column:
            ok = is_strings(x["k_subject"]) & F.size(x["subject"]).between(1, 3) & F.forall(x["subject"], lambda s: s.isNotNull() & (strip(s) != ""))
            for name in ("type", "audience", "purpose"):
                ok = ok & ((x[f"k_{name}"] == "VOID") | ((x[f"k_{name}"] == "STRING") & ~x[name].contains("_and_") & ~x[name].contains(",")))
            ok = ok & ((x["k_time"] == "VOID") | ((x["k_time"] == "STRING") & x["time"].isin(TIMES)))
            ok = ok & is_strings(x["k_content_flags"]) & (F.size(x["content_flags"]) <= most_flags) & F.forall(x["content_flags"], lambda s: s.isNotNull())
            return F.when(F.coalesce(ok, F.lit(False)), F.struct(*[x[n].alias(n) for n in ("subject", *SINGLE, "content_flags")]))

        lists = [F.try_variant_get(v, f"$.{n}", "array<string>").alias(n) for n in ("subject", "content_flags")]
        return let(F.struct(*lists, *[_string(v, f"$.{n}").alias(n) for n in SINGLE], *[kind(v, f"$.{n}").alias(f"k_{n}") for n in ("subject", *SINGLE, "content_flags")]), checked)

    return let(strict_json(lazy_json(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?s)<think>.*?</think>", ""), "subject")), build)


def lenient(content: Column, first_key: str = "topics") -> Column:
    """Whatever known lists were parsed; empty lists otherwise."""

    def build(v: Column) -> Column:
        listed = lambda k: F.coalesce(F.when(kind(v, f"$.{k}").startswith("ARRAY"), F.try_variant_get(v, f"$.{k}", "array<string>")), F.array().cast("array<string>"))
        return F.struct(listed("topics").alias("topics"), listed("tags").alias("tags"))

    return let(let(greedy_json(body(content), first_key), strict_json), build)


def cli_card(content: Column) -> Column:
    """The six keys as they come, or an error with the first 200 characters."""

    def build(c: Column) -> Column:
        def show(v: Column) -> Column:
            arr = lambda k: F.when(kind(v, f"$.{k}").startswith("ARRAY"), F.try_variant_get(v, f"$.{k}", "array<string>"))
            singles = [F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in SINGLE]
            return F.struct(arr("subject").alias("subject"), *singles, arr("content_flags").alias("content_flags"), F.when(v.isNull(), "unparsed").alias("error"), F.when(v.isNull(), F.left(c, F.lit(200))).alias("raw"))

        return let(let(lazy_json(F.coalesce(c, F.lit("")), "subject"), strict_json), show)

    return let(content, build)


def clean_single(type_: Column, audience: Column, purpose: Column, time: Column) -> Column:
    """Single-valued facets hold no compound, and time is of its closed set or null."""
    compound = F.lit(False)
    for c in (type_, audience, purpose):
        compound = compound | F.coalesce(c, F.lit("")).contains("_and_")
    return ~compound & (time.isNull() | time.isin(TIMES))
