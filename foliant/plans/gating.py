"""Queries on answer parsing and validation gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import gates, text
from foliant.functions.gates import FACETS, TOPICS
from foliant.operators import assemble, stats
from foliant.operators.rows import once
from foliant.plans.declare import declarer
from foliant.plans.fixtures import SQL_ANSWERS, SQL_CARDS, registered, responded, sql_hash, sql_pick, with_answers, with_cards, with_labels, with_topics
from foliant.plans.shared import stored
from foliant.streaming import gate as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = declarer(QUERIES, SQL)


def answers(spark, sf_dir):
    return with_answers(with_cards(registered(spark, sf_dir)))


def _sql_norm(x: str) -> str:
    return f"left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40)"


# the JSON object of an answer, and its checks; duckdb's json functions tell types, absence and null apart
_SQL_PARSED = f"""{SQL_ANSWERS},
found as (select i, content, trim(regexp_extract(content, '(?s)<think>(.*?)</think>', 1)) thought,
  regexp_extract(regexp_replace(regexp_replace(content, '(?s)<think>.*?</think>', '', 'g'), '```(json)?', '', 'g'), '(?s)\\{{\\s*"subject"\\s*:.*\\}}') j from answers),
valid as (select *, case when json_valid(j) then j end v from found),
typed as (select *, list_filter(list_distinct(list_transform(coalesce(json_extract_string(v, '$.subject[*]'), []), lambda x: {_sql_norm("x")})), lambda x: x <> '') subject,
  {", ".join(f"json_type(v, '$.{k}') t_{k}" for k in ("type", "audience", "time", "purpose", "content_flags"))}, json_array_length(v, '$.content_flags') n_flags from valid),
gated as (select *, case when content is null then 'no_response' when len(list_filter(string_split(thought, ' '), lambda x: x <> '')) < 25 then 'no_think' when j = '' then 'no_json' when v is null then 'bad_json'
  when len(subject) not between 1 and 3 then 'subject_count:' || len(subject)
  {" ".join(f"when coalesce(t_{k}, 'NULL') not in ('VARCHAR', 'NULL') then 'bad_{k}'" for k in ("type", "audience", "time", "purpose"))}
  when coalesce(t_content_flags, 'NULL') <> 'NULL' and (t_content_flags <> 'ARRAY' or n_flags > 4) then 'bad_flags' end reason from typed)"""


@query(f"with {_SQL_PARSED} select i, coalesce(reason, 'ok') reason from gated")
def gate_facet_reasons(spark, sf_dir):
    return answers(spark, sf_dir).select("i", F.coalesce(gates.faceted_gate(F.col("content"))["reason"], F.lit("ok")).alias("reason"))


@query(f"with {_SQL_PARSED} select reason, count(*) n from gated where reason is not null group by reason order by n desc, reason limit 12")
def gate_facet_rejects(spark, sf_dir):
    return stats.reject_histogram(answers(spark, sf_dir).select(gates.faceted_gate(F.col("content"))["reason"].alias("reason")))


@query(f"""with {_SQL_PARSED} select i, json_extract_string(v, '$.type') "type", json_extract_string(v, '$.time') "time", json_extract_string(v, '$.audience') audience, json_extract_string(v, '$.purpose') purpose, array_to_string(json_extract_string(v, '$.content_flags[*]'), ',') flags from gated where reason is null""")
def gate_facet_values(spark, sf_dir):
    d = once(answers(spark, sf_dir).select("i", "content"), g=gates.faceted_gate(F.col("content"))).where("g.ok")
    return d.select("i", "g.value.type", "g.value.time", "g.value.audience", "g.value.purpose", F.array_join("g.value.content_flags", ",").alias("flags"))


@query(f"with {_SQL_PARSED} select count_if(reason is null)::bigint survivors, count_if(reason is not null)::bigint rejects, round(count_if(reason is null) / count(*), 6)::double \"yield\" from gated")
def gate_yield(spark, sf_dir):
    d = answers(spark, sf_dir).select(gates.faceted_gate(F.col("content"))["ok"].alias("ok"))
    return stats.yields(d).withColumn("yield", F.round("yield", 6))


@query(f"with {_SQL_PARSED} select case when i % 50 = 3 then 'orphan' else src end src, count(*) n from gated join (select i, src from reg) using (i) where reason is null group by 1")
def harvest_survivors(spark, sf_dir):
    """Responses, gated and joined with their documents; a fiftieth of the documents is missing from the manifest."""
    d = answers(spark, sf_dir)
    responses = d.select(text.custom_id("EN", F.col("i")).alias("custom_id"), responded(F.col("content")).alias("response"))
    kept = stored(once(assemble.answers(responses), ok=gates.faceted_gate(F.col("content"))["ok"]).where("ok").select("i"), "kept")
    joined, orphans = assemble.with_manifest(kept, registered(spark, sf_dir).where("i % 50 != 3").select("i", "src"))
    return stats.counts(joined.select("src").unionAll(orphans.select(F.lit("orphan"))), "src")


_SQL_CARD = f"""{SQL_ANSWERS},
found as (select i, regexp_extract(regexp_replace(coalesce(content, ''), '(?s)<think>.*?</think>', '', 'g'), '(?s)\\{{\\s*"subject"\\s*:.*?\\}}') j from answers),
valid as (select i, case when json_valid(j) then j end v from found),
card_ok as (select i, v, coalesce(json_type(v, '$.subject') = 'ARRAY' and json_array_length(v, '$.subject') between 1 and 3
  and json_type(v, '$.type') in ('VARCHAR', 'NULL') and coalesce(json_extract_string(v, '$.type') not like '%\\_and\\_%' escape '\\', true)
  and json_type(v, '$.audience') in ('VARCHAR', 'NULL') and json_type(v, '$.purpose') in ('VARCHAR', 'NULL')
  and json_type(v, '$.time') in ('VARCHAR', 'NULL') and coalesce(json_extract_string(v, '$.time') in ('historical', 'current', 'forward_looking'), true)
  and json_array_length(v, '$.content_flags') <= 3, false) ok from valid)"""


@query(f"""with {_SQL_CARD} select i, ok, case when ok then array_to_string(json_extract_string(v, '$.subject[*]'), ',') end subject from card_ok""")
def card_schema_gate(spark, sf_dir):
    card = gates.card_gate(F.col("content"))
    return answers(spark, sf_dir).select("i", card.alias("c")).select("i", F.col("c").isNotNull().alias("ok"), F.array_join("c.subject", ",").alias("subject"))


@query(f"""with {SQL_ANSWERS}, found as (select i, content, regexp_extract(coalesce(content, ''), '(?s)\\{{\\s*"subject"\\s*:.*?\\}}') j from answers), valid as (select *, case when json_valid(j) then j end v from found)
select i, json_extract_string(v, '$.type') "type", array_to_string(json_extract_string(v, '$.content_flags[*]'), ',') flags, case when v is null then 'unparsed' end error, case when v is null then left(content, 200) end raw from valid""")
def cli_cards(spark, sf_dir):
    d = answers(spark, sf_dir).select("i", gates.cli_card(F.col("content")).alias("c"))
    return d.select("i", "c.type", F.array_join("c.content_flags", ",").alias("flags"), "c.error", "c.raw")


def _sql_label(n: int) -> str:
    out = f"""'{{"topic": "' || {sql_pick(f"'topic{n}-' || i", [*TOPICS, "weather"])} || '"'"""
    for k, values in FACETS.items():
        out += f""" || ', "{k}": "' || {sql_pick(f"'{k}{n}-' || i", values * 6 + ["odd"])} || '"'"""
    return out + " || '}'"


_SQL_LABELS = f"""{SQL_CARDS},
labelled as (select i, src, [{_sql_label(1)}] || case when {sql_hash("'two-' || i", 2)} = 1 then [{_sql_label(2)}] else [] end labels, {sql_hash("'short-' || i", 9)} = 0 short from cards),
faults as (select *, list_filter(list_transform(labels, lambda l: case when json_extract_string(l, '$.topic') not in ({", ".join(f"'{t}'" for t in TOPICS)}) then 'off_topic:' || json_extract_string(l, '$.topic')
  {" ".join(f"when json_extract_string(l, '$.{k}') = 'odd' then 'off_facet:{k}=odd'" for k in FACETS)} end), lambda x: x is not null) f from labelled),
gated as (select *, case when short then 'no_think' else f[1] end reason from faults)"""


@query(f"with {_SQL_LABELS} select reason, count(*) n from gated where reason is not null group by reason order by n desc, reason limit 12")
def gate_ontology_rejects(spark, sf_dir):
    d = with_labels(registered(spark, sf_dir)).select(gates.ontology_gate(F.col("content"))["reason"].alias("reason"))
    return stats.reject_histogram(d)


@query(f"""with {_SQL_LABELS}, ok as (select i, unnest(labels) l, generate_subscripts(labels, 1) k from gated where reason is null),
tags as (select i, t, min(o) o from (select i, unnest([{", ".join(f"json_extract_string(l, '$.{k}')" for k in FACETS)}]) t, k * 10 + unnest(range(5)) o from ok) group by i, t),
firsts as (select i, t, min(k) o from (select i, json_extract_string(l, '$.topic') t, k from ok) group by i, t)
select i, topics, tags from (select i, string_agg(t, ',' order by o) topics from firsts group by i) join (select i, string_agg(t, ',' order by o) tags from tags group by i) using (i)""")
def flat_view(spark, sf_dir):
    d = once(with_labels(registered(spark, sf_dir)).select("i", "content"), g=gates.ontology_gate(F.col("content"))).where("g.ok")
    topics, tags = text.flat_view(F.col("g.value"))
    return d.select("i", F.array_join(topics, ",").alias("topics"), F.array_join(tags, ",").alias("tags"))


_SQL_TOPICS = f"""{SQL_CARDS},
open as (select i, case when {sql_hash("'nt-' || i", 7)} = 0 then 0 else len(subject) end n_topics, case when {sql_hash("'ng-' || i", 7)} = 0 then 0 else 2 end n_tags, subject, src, lang from cards)"""


@query(f"with {_SQL_TOPICS} select i, case when n_topics = 0 then 'topics_count:0' when n_tags = 0 then 'tags_count:0' else 'ok' end reason, case when n_topics > 0 and n_tags > 0 then array_to_string(subject, ',') end topics, case when n_topics > 0 and n_tags > 0 then src || ',' || lang end tags from open")
def gate_openvocab(spark, sf_dir):
    d = with_topics(with_cards(registered(spark, sf_dir))).select("i", gates.openvocab_gate(F.col("content")).alias("g"))
    return d.select("i", F.coalesce("g.reason", F.lit("ok")).alias("reason"), F.array_join("g.value.topics", ",").alias("topics"), F.array_join("g.value.tags", ",").alias("tags"))


@query(f"with {_SQL_TOPICS} select sum(n_topics)::bigint topics, sum(case when n_tags > 0 then 3 else 0 end)::bigint tags, count_if(n_topics = 0)::bigint empty from open")
def lenient_predictions(spark, sf_dir):
    d = with_topics(with_cards(registered(spark, sf_dir))).select(gates.lenient(F.col("content")).alias("p"))
    return d.agg(F.sum(F.size("p.topics")).cast("long").alias("topics"), F.sum(F.size("p.tags")).cast("long").alias("tags"), F.count_if(F.size("p.topics") == 0).alias("empty"))


@query(f"""with {SQL_CARDS} select audience, count_if(not contains(coalesce("type", ''), '_and_'))::bigint clean from cards group by audience""")
def clean_compound(spark, sf_dir):
    ok = gates.clean_single(F.col("type"), F.col("audience"), F.col("purpose"), F.col("time"))
    return with_cards(registered(spark, sf_dir)).groupBy("audience").agg(F.count_if(ok).alias("clean"))


@query(f"with {_SQL_PARSED} select coalesce(reason, 'ok') reason, count(*) n from gated group by 1")
def stream_gate(spark, sf_dir):
    """The gate over answers that arrive as files, as a stream; the counts are those of the batch gate."""
    from foliant.plans.shared import shared_folder

    base = shared_folder(spark, "stream")
    answers(spark, sf_dir).select("i", "content").write.option("ignoreNullFields", "false").json(f"{base}/in")
    stream = streaming.read_answers(spark, f"{base}/in", "i long, content string")
    streaming.run_gate(stream, gates.faceted_gate, f"{base}/ok", f"{base}/rejects", f"{base}/checkpoint", "i").awaitTermination()
    ok = spark.read.schema("i long").parquet(f"{base}/ok").select(F.lit("ok").alias("reason"))
    return stats.counts(ok.unionAll(spark.read.schema("i long, reason string").parquet(f"{base}/rejects").select("reason")), "reason")
