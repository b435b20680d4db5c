"""Inputs derived from the fixture tables, the same in Spark and in SQL: registers, cards, answers, verdicts, scores."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.hashing import hash_mod, key
from foliant.functions.gates import FACETS, TOPICS
from foliant.functions.text import let
from foliant.operators.rows import once

REGISTERS = ["mail", "pdf", "ticket", "chat", "code", "log"]
TYPES = ["email_thread", "report_document", "issue_ticket", "chat_log", "source_code", "system_log"]
TIMES = ["historical", "current", "forward_looking"]
PURPOSES = ["inform_readers", "request_action", "record_event"]
FLAGS = [("has_email", "[a-z0-9.]+@[a-z0-9]+[.]"), ("has_license", "license|copyright"), ("has_secret", "token|password|secret")]
POOL = {
    "canonical": TOPICS,
    "paraphrases": [["pay", "staffing", "deals"], ["money", "law", "people"], ["safety", "rivals", "rules"]],
    "alternatives": [["weather", "sports"], ["music", "film", "books"]],
}
DOMAINS = ["medicine", "farming", "shipping", "sports", "cooking"]
THOUGHT = "because the text says so "
#: Words of the fixture's own rare topics.
RARE = "(?i)(token|password|secret|license|copyright)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, src, id, fp, text, lang of each document; a twentieth has no id."""
    d = table(spark, sf_dir, "documents")
    n = F.pmod(F.substring(F.col("source"), 4, 9).cast("int"), F.lit(6))
    return d.select(F.col("doc_id").alias("i"), F.get(F.array(*map(F.lit, REGISTERS)), n).alias("src"), F.when(F.col("doc_id") % 20 != 7, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("id"), F.sha2("text", 256).alias("fp"), "text", "lang")


def pick(k: Column, values: list, m: int | None = None) -> Column:
    """values by hash; null for buckets beyond them."""
    return F.get(F.array(*map(F.lit, values)), hash_mod(k, m or len(values)).cast("int"))


def found(text: Column, pattern: str) -> Column:
    """Whether a pattern of FLAGS matches: plain words are looked for as such, and an address only where there is an at sign."""
    words = pattern.split("|")
    if all(w.isalpha() for w in words):
        return functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in words])
    return F.contains(text, F.lit("@")) & text.rlike(pattern) if "@" in pattern else text.rlike(pattern)


def with_cards(df: DataFrame) -> DataFrame:
    """Adds subject, type, audience, time, purpose, content_flags, by rules."""
    low = F.lower(F.left("text", F.lit(4000)))
    i = F.col("i")

    def most_frequent(words: Column) -> Column:
        """Of the sorted words, the three with the longest runs; a run is as long as the way to the next one's start."""
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: (k == 0) | (F.get(words, k) != F.get(words, k - 1)))
        runs = lambda s: F.transform(s, lambda at, k: F.struct((at - F.coalesce(F.get(s, k + 1), F.size(words))).alias("o"), F.get(words, at).alias("w")))
        return F.when(F.size(words) > 0, F.transform(F.slice(F.sort_array(let(starts, runs)), 1, 3), lambda x: x["w"])).otherwise(F.array().cast("array<string>"))

    return df.withColumns({
        "subject": let(F.sort_array(F.regexp_extract_all(low, F.lit("[a-z]{6,}"), F.lit(0))), most_frequent),
        "type": F.get(F.array(*map(F.lit, TYPES)), (F.array_position(F.array(*map(F.lit, REGISTERS)), F.col("src")) - 1).cast("int")),
        "audience": F.when(F.col("lang") == "en", "engineers").when(F.col("lang") == "fr", "customers").when(F.col("lang") == "de", "management_team"),
        "time": pick(key("time-", i), TIMES, 4),
        "purpose": pick(key("purpose-", i), PURPOSES),
        "content_flags": let(low, lambda t: F.filter(F.array(*[F.when(found(t, p), n) for n, p in FLAGS]), lambda x: x.isNotNull())),
    })


def quoted(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))


def _or_null(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))


def card_text(subject, type_, audience, time, purpose, flags) -> Column:
    return F.concat(F.lit('{"subject": '), subject, F.lit(', "type": '), type_, F.lit(', "audience": '), audience, F.lit(', "time": '), time, F.lit(', "purpose": '), purpose, F.lit(', "content_flags": '), flags, F.lit("}"))


def with_answers(df: DataFrame) -> DataFrame:
    """Adds bucket and content: a thought and a card, spoilt in a way of its own in each bucket but 0."""
    df = once(df, subject=F.col("subject"), content_flags=F.col("content_flags"), bucket=hash_mod(key("resp-", F.col("i")), 12))
    b = F.col("bucket")
    subject = F.when(b == 5, '["aa", "bb", "cc", "dd"]').when(b == 6, "[]").otherwise(quoted(F.col("subject")))
    type_ = F.when(b == 4, "7").otherwise(_or_null(F.col("type")))
    time = F.when(b == 10, '"someday"').otherwise(_or_null(F.col("time")))
    flags = F.when(b == 7, '["a1", "a2", "a3", "a4", "a5"]').otherwise(quoted(F.col("content_flags")))
    card = card_text(subject, type_, _or_null(F.col("audience")), time, _or_null(F.col("purpose")), flags)
    card = F.when(b == 2, "nothing to add").when(b == 3, F.concat(F.left(card, F.length(card) - 1), F.lit(", oops}"))).when(b == 8, F.concat(F.lit("```json\n"), card, F.lit("\n```"))).when(b == 9, F.concat(card, F.lit("\nThat is all."))).otherwise(card)
    thought = F.concat(F.lit("<think>"), F.repeat(F.lit(THOUGHT), F.when(b == 1, 3).otherwise(8)), F.lit("</think>\n"))
    return once(df, content=F.when(b != 11, F.concat(thought, card)))


def with_labels(df: DataFrame) -> DataFrame:
    """Adds labels: one or two closed-ontology labels as JSON text with a thought; some topics and facets off the lists."""
    i = F.col("i")

    def one(n: int) -> Column:
        parts = [F.lit('{"topic": "'), pick(key(f"topic{n}-", i), [*TOPICS, "weather"]), F.lit('"')]
        for k, values in FACETS.items():
            parts += [F.lit(f', "{k}": "'), pick(key(f"{k}{n}-", i), values * 6 + ["odd"]), F.lit('"')]
        return F.concat(*parts, F.lit("}"))

    both = F.concat(F.lit('{"labels": ['), one(1), F.when(hash_mod(key("two-", i), 2) == 1, F.concat(F.lit(", "), one(2))).otherwise(""), F.lit("]}"))
    return once(df, content=F.concat(F.lit("<think>"), F.repeat(F.lit(THOUGHT), F.when(hash_mod(key("short-", i), 9) == 0, 2).otherwise(8)), F.lit("</think>\n"), both))


def with_topics(df: DataFrame) -> DataFrame:
    """Adds content: open topics and tags as JSON text; some lists empty."""
    i = F.col("i")
    none = lambda k, c: F.when(hash_mod(key(k, i), 7) == 0, "[]").otherwise(quoted(c))
    return df.withColumn("content", F.concat(F.lit("<think>"), F.repeat(F.lit(THOUGHT), 8), F.lit('</think>{"topics": '), none("nt-", F.col("subject")), F.lit(', "tags": '), none("ng-", F.array("src", "lang", "lang")), F.lit("}")))


def gold_and_pred(cards: DataFrame) -> DataFrame:
    """i, gold, pred: subjects, and subjects thinned with an extra one; some empty."""
    i, empty = F.col("i"), F.array().cast("array<string>")
    thin = F.filter("subject", lambda s: hash_mod(F.concat(F.lit("thin-"), i.cast("string"), F.lit("-"), s), 3) > 0)
    pred = F.concat(thin, F.when(hash_mod(key("extra-", i), 4) == 0, F.array(F.lit("extra_term"))).otherwise(empty))
    return cards.select("i", "src", F.when(hash_mod(key("ge-", i), 9) == 0, empty).otherwise(F.col("subject")).alias("gold"), F.when(hash_mod(key("pe-", i), 9) == 0, empty).otherwise(pred).alias("pred"))


def verdicts(cards: DataFrame, *keep: str) -> DataFrame:
    """i, the columns to keep, mode, failed, grades, missed, facet_ok, flags_ok, redundant, tags_apt, n_tags."""
    from foliant.functions.hashing import conditioning_mode

    i = F.col("i")
    grade = lambda s, k: F.get(F.array(*map(F.lit, ("precise", "precise", "vague", "wrong"))), hash_mod(F.concat(F.lit("grade-"), i.cast("string"), F.lit("-"), k.cast("string")), 4).cast("int"))
    return cards.select(
        "i", *keep, F.substring_index(conditioning_mode(i, DOMAINS), ":", 1).alias("mode"), (hash_mod(key("bad-", i), 50) == 0).alias("failed"),
        F.transform("subject", grade).alias("grades"), F.least(F.lit(3), hash_mod(key("miss-", i), 5)).cast("int").alias("missed"),
        F.array(*[hash_mod(key(f"ok-{k}-", i), 5) > 0 for k in ("type", "audience", "time", "purpose")]).alias("facet_ok"),
        F.transform("content_flags", lambda f: hash_mod(F.concat(F.lit("flag-"), i.cast("string"), f), 3) > 0).alias("flags_ok"),
        hash_mod(key("red-", i), 2).cast("int").alias("redundant"), hash_mod(key("apt-", i), 3).cast("int").alias("tags_apt"), (hash_mod(key("apt-", i), 3) + hash_mod(key("tags-", i), 3)).cast("int").alias("n_tags"),
    )


def candidates(cards: DataFrame, *keep: str) -> DataFrame:
    """i, the columns to keep, candidates, scores: four cards, of which the last two are malformed; in some rows all alike, a score short, or no score."""
    i, b = F.col("i"), F.col("b")
    cards = once(cards.select("i", *keep, "subject"), subject=F.col("subject"), b=hash_mod(key("cand-", i), 10))
    lit = lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in x])
    one = lambda subject, type_: lit('{"subject": ', subject, ', "type": ', type_, ', "audience": null, "time": null, "purpose": "inform_readers", "content_flags": []}')
    c = F.array(one(quoted(F.col("subject")), '"report_document"'), one(quoted(F.slice("subject", 1, 1)), "null"), one(quoted(F.col("subject")), '"mail_and_report"'), F.lit("none"))
    score = lambda k: hash_mod(key(f"score-{k}-", i), 11).cast("double")
    scores = F.when(b == 1, F.array(score(0), score(1), score(2))).when(b == 2, F.lit(None)).otherwise(F.array(*[score(k) for k in range(4)]))
    return once(cards, candidates=F.when(b == 0, F.array_repeat(one('["same"]', "null"), 4)).otherwise(c), scores=scores).select("i", *keep, "candidates", "scores")


#: What a judge writes for a truth value, and whether it counts as true.
TRUTHS = [("true", 1), ("false", 0), ('"false"', 1), ('""', 0), ("0", 0), ("2.5", 1), ("null", 0), ("[]", 0), ("[0]", 1), ("{}", 0)]
GRADED = ["precise", "vague", "wrong", "great", "n/a"]
MISSED = ["0", "1", "4", '"2"', "2.7", "true", "-1", '" 3 "']
MISSED_AS = [0, 1, 3, 2, 2, 1, 0, 3]


def judged(cards: DataFrame) -> DataFrame:
    """i, mode, content: a judge's answer over a card; in buckets 0 to 4 there is none, no JSON, broken JSON, no count, or a wrong type."""
    from foliant.functions.hashing import conditioning_mode

    i = F.col("i")
    b = hash_mod(key("jb-", i), 16)
    listed = lambda values: F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))
    grades = F.transform("subject", lambda s, k: F.concat(F.lit('"'), pick(F.concat(F.lit("jg-"), i.cast("string"), F.lit("-"), k.cast("string")), GRADED), F.lit('"')))
    oks = [F.concat(F.lit(f'"{k}": '), pick(key(f"jo-{k}-", i), [t for t, _ in TRUTHS])) for k in ("type", "audience", "purpose")]
    flags = listed(F.transform("content_flags", lambda f: pick(F.concat(F.lit("jf-"), i.cast("string"), f), [t for t, _ in TRUTHS])))
    fields = F.array_compact(F.array(
        F.concat(F.lit('"subject_grades": '), listed(grades)), F.concat(F.lit('"topic_grades": '), listed(grades)), F.concat(F.lit('"tags_apt": '), pick(key("jt-", i), ["0", "1", "2", '"1"', "-3"])),
        F.when(b != 3, F.concat(F.lit('"missed": '), pick(key("jm-", i), MISSED))),
        F.when(b == 4, F.lit('"facet_ok": ["type"]')).otherwise(F.concat(F.lit('"facet_ok": {'), F.array_join(F.array(*oks), ", "), F.lit("}"))),
        F.when(b != 5, F.concat(F.lit('"flags_ok": '), flags)), F.when(b != 6, F.concat(F.lit('"redundant_pairs": '), pick(key("jr-", i), ["-1", "0", "1", '"2"']))),
    ))
    text = F.concat(F.lit("My verdict: {"), F.array_join(fields, ", "), F.lit("} That is all."))
    content = F.when(b == 0, F.lit(None)).when(b == 1, "I can't say.").when(b == 2, F.concat(F.left(text, F.lit(30)), F.lit("}"))).otherwise(text)
    return cards.select("i", F.substring_index(conditioning_mode(i, DOMAINS), ":", 1).alias("mode"), content.alias("content"))


RANKED = ["0", "3", "7.5", '"9"', "true", '" 6.5 "', "10", "2", "null", '"high"']
RANKED_AS = [0.0, 3.0, 7.5, 9.0, 1.0, 6.5, 10.0, 2.0, None, None]


def ranked(cards: DataFrame) -> DataFrame:
    """custom_id and response of a ranking judge: four scores, some no numbers; in buckets 0 to 2 none, no list, or one short."""
    i = F.col("i")
    b = hash_mod(key("rb-", i), 12)
    scores = [pick(F.concat(F.lit(f"rs-{k}-"), i.cast("string")), RANKED[:8] * 4 + RANKED[8:]) for k in range(4)]
    text = lambda n: F.concat(F.lit('{"scores": ['), F.array_join(F.array(*scores[:n]), ", "), F.lit("]}"))
    content = F.when(b == 0, "none").when(b == 1, '{"scores": 5}').when(b == 2, text(3)).otherwise(text(4))
    return cards.select(F.concat(F.lit("RK-"), i.cast("string")).alias("custom_id"), responded(content).alias("response"))


def responded(content: Column) -> Column:
    """A batch response that holds the content."""
    return F.struct(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("body"))


# ---- the same in SQL ----


def sql_hash(k: str, m: int) -> str:
    """hash_mod of a string expression."""
    return f"list_reduce(list_prepend(0::bigint, list_transform(range(1, 65), lambda p: (instr('0123456789abcdef', substr(sha256({k}), p::int, 1)) - 1)::bigint)), lambda a, b: (a * 16 + b) % {m})"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_pick(k: str, values: list, m: int | None = None) -> str:
    return f"list_extract({sql_list(values)}, ({sql_hash(k, m or len(values))} + 1)::int)"


SQL_REG = f"""reg as (select doc_id i, list_extract({sql_list(REGISTERS)}, substr(source, 4)::int % 6 + 1) src, case when doc_id % 20 <> 7 then 'd' || doc_id end id, sha256(text) fp, text, lang from documents)"""
SQL_CARDS = f"""{SQL_REG},
words as (select i, w, count(*) c from (select i, unnest(regexp_extract_all(lower(left(text, 4000)), '[a-z]{{6,}}')) w from reg) group by i, w),
tops as (select i, list(w order by c desc, w) subject from (select *, row_number() over (partition by i order by c desc, w) r from words) where r <= 3 group by i),
cards as (select reg.*, coalesce(subject, []::varchar[]) subject, list_extract({sql_list(TYPES)}, list_position({sql_list(REGISTERS)}, src)) "type",
  case lang when 'en' then 'engineers' when 'fr' then 'customers' when 'de' then 'management_team' end audience,
  {sql_pick("'time-' || i", TIMES, 4)} "time", {sql_pick("'purpose-' || i", PURPOSES)} purpose,
  list_filter([{", ".join(f"case when regexp_matches(lower(left(text, 4000)), '{p}') then '{n}' end" for n, p in FLAGS)}], lambda x: x is not null) content_flags
  from reg left join tops using (i))"""


def sql_quoted(c: str) -> str:
    return f"'[' || array_to_string(list_transform({c}, lambda x: '\"' || x || '\"'), ', ') || ']'"


def _sql_null(c: str) -> str:
    return f"coalesce('\"' || {c} || '\"', 'null')"


SQL_ANSWERS = f"""{SQL_CARDS},
spoilt as (select *, {sql_hash("'resp-' || i", 12)} bucket from cards),
plain as (select *, '{{"subject": ' || case bucket when 5 then '["aa", "bb", "cc", "dd"]' when 6 then '[]' else {sql_quoted("subject")} end || ', "type": ' || case bucket when 4 then '7' else {_sql_null('"type"')} end
  || ', "audience": ' || {_sql_null("audience")} || ', "time": ' || case bucket when 10 then '"someday"' else {_sql_null('"time"')} end || ', "purpose": ' || {_sql_null("purpose")}
  || ', "content_flags": ' || case bucket when 7 then '["a1", "a2", "a3", "a4", "a5"]' else {sql_quoted("content_flags")} end || '}}' card from spoilt),
answers as (select *, case when bucket <> 11 then '<think>' || repeat('{THOUGHT}', case bucket when 1 then 3 else 8 end) || '</think>' || chr(10)
  || case bucket when 2 then 'nothing to add' when 3 then left(card, length(card) - 1) || ', oops}}' when 8 then '```json' || chr(10) || card || chr(10) || '```' when 9 then card || chr(10) || 'That is all.' else card end end content from plain)"""



def sql_one(subject: str, type_: str) -> str:
    return f"""'{{"subject": ' || {subject} || ', "type": ' || {type_} || ', "audience": null, "time": null, "purpose": "inform_readers", "content_flags": []}}'"""


def sql_truth(k: str) -> str:
    return f"list_extract({[v for _, v in TRUTHS]}, ({sql_hash(k, len(TRUTHS))} + 1)::int) = 1"


SQL_JUDGED = f"""{SQL_CARDS},
judged as (select i, {sql_hash("'jb-' || i", 16)} b, content_flags,
  list_filter(list_transform(range(len(subject)), lambda k: {sql_pick("'jg-' || i || '-' || k", GRADED)}), lambda g: g in ('precise', 'vague', 'wrong')) grades,
  list_extract({MISSED_AS}, ({sql_hash("'jm-' || i", len(MISSED))} + 1)::int) missed, greatest(0, list_extract([0, 1, 2, 1, -3], ({sql_hash("'jt-' || i", 5)} + 1)::int)) tags_apt,
  [{sql_truth("'jo-type-' || i")}, {sql_truth("'jo-audience-' || i")}, false, {sql_truth("'jo-purpose-' || i")}] facet_ok,
  list_transform(content_flags, lambda f: {sql_truth("'jf-' || i || f")}) flags_ok, greatest(0, list_extract([-1, 0, 1, 2], ({sql_hash("'jr-' || i", 4)} + 1)::int)) redundant from cards)"""
