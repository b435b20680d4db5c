"""Queries on sources, samples, buckets, terms and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import hashing, text
from foliant.operators import catalog, sampling, stats
from foliant.plans.declare import declarer
from foliant.plans.fixtures import DOMAINS, POOL, RARE, SQL_CARDS, SQL_REG, registered, sql_hash, sql_list, sql_pick, table, with_cards
from foliant.sources.readers import dataset, fingerprint, register_text, ticket_text

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = declarer(QUERIES, SQL)
_QUOTAS = {"mail": 20, "pdf": 15, "ticket": 10, "chat": 8, "code": 6, "log": 4}
_GATED = "length(text) between 200 and 20000"


def cards(spark, sf_dir):
    return with_cards(registered(spark, sf_dir))


def gated(spark, sf_dir):
    return registered(spark, sf_dir).where(sampling.length_gate(F.col("text")))


@query(f"with {SQL_CARDS} select subject, count(*) n from (select unnest(subject) subject from cards) group by 1 order by n desc, subject limit 10")
def subject_frequency(spark, sf_dir):
    return stats.subject_frequency(cards(spark, sf_dir))


@query(f"with {SQL_CARDS} select flag, count(*) n from (select unnest(content_flags) flag from cards) group by 1 order by n desc, flag limit 10")
def top_content_flags(spark, sf_dir):
    return stats.flag_frequency(cards(spark, sf_dir))


@query(f"""with {SQL_CARDS} select count(*) n, count_if("type" is null)::bigint null_type, count_if(audience is null)::bigint null_audience, count_if("time" is null)::bigint null_time, count_if(purpose is null)::bigint null_purpose from cards""")
def null_facets(spark, sf_dir):
    return stats.null_facets(cards(spark, sf_dir))


@query(f"with {SQL_REG} select src, count_if({_GATED})::bigint passed, count_if(not ({_GATED}))::bigint dropped from reg group by src")
def source_gate_counts(spark, sf_dir):
    ok = sampling.length_gate(F.col("text"))
    return registered(spark, sf_dir).groupBy("src").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("dropped"))


@query("select role, count(*) n, sum(length(coalesce(case when role = 'user' then text end, '')))::bigint chars from conversations group by role")
def text_extraction_chat(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("register", F.when(F.col("role") == "user", "chat").otherwise("mail"))
    body = register_text(F.col("register"), F.lit(None).cast("string"), F.col("text"), F.lit(None).cast("string"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length(body)).cast("long").alias("chars"))


_BLANK = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"


@query(f"""with {SQL_REG}, cut as (select i, string_split(text, ' ') w from reg),
parts as (select i, [case when {_BLANK.replace("x,", "w[1],")} <> '' then 'Issue: ' || w[1] end, case when i % 3 > 0 and {_BLANK.replace("x,", "w[2],")} <> '' then {_BLANK.replace("x,", "w[2],")} end]
  || list_transform(list_slice(w, 3, 8), lambda x: case when {_BLANK} <> '' then 'Comment: ' || {_BLANK} end) p from cut)
select i, array_to_string(list_filter(p, lambda x: x is not null), chr(10) || chr(10)) ticket from parts""")
def ticket_flatten(spark, sf_dir):
    d = registered(spark, sf_dir).select("i", F.split("text", " ").alias("w"))
    issue = F.to_json(F.struct(F.get("w", F.lit(0)).alias("summary"), F.when(F.col("i") % 3 > 0, F.get("w", F.lit(1))).alias("description")))
    comments = F.to_json(F.transform(F.slice("w", 3, 9), lambda x: F.struct(x.alias("body"))))
    return d.select("i", ticket_text(issue, comments).alias("ticket"))


@query(f"""with {SQL_REG}, cut as (select i, list_filter(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' '), lambda x: x <> '') w from reg)
select i, array_to_string(list_filter([case when w[1] is not null then 'Issue: ' || w[1] end] || list_transform(list_slice(w, 2, 4), lambda x: 'Comment: ' || x), lambda x: x is not null), chr(10) || chr(10)) ticket from cut""")
def ticket_literals(spark, sf_dir):
    """Tickets whose issue is a Python literal and whose comments are either a literal or JSON."""
    d = registered(spark, sf_dir).select("i", F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z ]", ""), " "), lambda x: x != "").alias("w"))
    issue = F.concat(F.lit("{'summary': "), F.coalesce(F.concat(F.lit("'"), F.get("w", F.lit(0)), F.lit("'")), F.lit("None")), F.lit(", 'description': None, 'open': True}"))
    bodies = F.transform(F.slice("w", 2, 3), lambda x: F.concat(F.lit("{'body': '"), x, F.lit("'}")))
    literal = F.concat(F.lit("["), F.array_join(bodies, ", "), F.lit("]"))
    comments = F.when(F.col("i") % 2 == 0, literal).otherwise(F.translate(literal, "'", '"'))
    return d.select("i", ticket_text(issue, comments, literals=True).alias("ticket"))


@query("select 'events#' || doc_id \"name\", length(text)::int n from documents where doc_id < 300 and length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 200")
def dataset_scan_limit(spark, sf_dir):
    d = dataset(table(spark, sf_dir, "documents"), "events", "doc_id", limit=300)
    return d.select("name", F.length("text").alias("n"))


@query(f"with {SQL_REG} select i, coalesce(nullif(case when i % 2 = 0 then fp end, ''), nullif(id, ''), sha256(left('{{\"i\":' || i || '}}', 2000))) fp from reg")
def record_fingerprints(spark, sf_dir):
    d = registered(spark, sf_dir)
    return d.select("i", fingerprint(F.when(F.col("i") % 2 == 0, F.col("fp")), F.col("id"), F.to_json(F.struct("i"))).alias("fp"))


@query(f"with {SQL_REG} select i, sha256(left(text, 4000)) cut, length(left(text, 4000))::int n from reg")
def text_cut_digest(spark, sf_dir):
    cut = F.left("text", F.lit(4000))
    return registered(spark, sf_dir).select("i", F.sha2(cut, 256).alias("cut"), F.length(cut).alias("n"))


def _sql_quota(prefix: str, quotas: dict[str, int], out: str = "quota") -> str:
    case = " ".join(f"when '{s}' then {q}" for s, q in quotas.items())
    ord_ = " ".join(f"when '{s}' then {k}" for k, s in enumerate(quotas))
    return f"""ranked as (select *, row_number() over (partition by src order by sha256('{prefix}' || fp), i) as "rank" from reg where {_GATED} and src in ({", ".join(f"'{s}'" for s in quotas)})),
{out} as (select *, case src {ord_} end src_ord from ranked where "rank" <= case src {case} end)"""


@query(f"with {SQL_REG}, {_sql_quota('more-', _QUOTAS)} select src, i, \"rank\"::int \"rank\", fp from quota")
def hash_sample_quota(spark, sf_dir):
    return sampling.quota_top(gated(spark, sf_dir), _QUOTAS, "more-").select("src", "i", F.col("rank"), "fp")


@query(f"""with {SQL_REG}, {_sql_quota('', _QUOTAS)},
base as (select * from (select *, row_number() over (partition by fp order by src_ord, "rank") s from quota) where s = 1),
pool as (select * from reg where {_GATED} and src in ('mail', 'pdf', 'ticket') and regexp_matches(left(text, 6000), '{RARE}') and fp not in (select fp from base)),
boost as (select * from pool order by sha256(fp), i limit 25),
boosted as (select * from (select *, row_number() over (partition by fp order by i) s from boost) where s = 1)
select i, src, 'base' tier from base union all select i, src, 'boost' tier from boosted""")
def sample_base_boost(spark, sf_dir):
    return sampling.base_and_boost(gated(spark, sf_dir), _QUOTAS, RARE, target=25).select("i", "src", "tier")


@query(f"""with {SQL_REG} select count(*) n, count_if(id is null)::bigint without_id, (select coalesce(max(i) + 1, 0) from reg) next_id from reg
where (id is null or id not in (select 'd' || doc_id from labels)) and fp not in (select fp from reg where i in (select doc_id from labels))""")
def sample_excluding_used(spark, sf_dir):
    d = registered(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    used = labels.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    used_fp = d.join(labels, d.i == labels.doc_id, "left_semi").select("fp")
    out = sampling.excluding(d, used, "id", used_fp).agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("without_id"))
    return out.withColumn("next_id", F.lit(sampling.next_id(d)).cast("long"))


@query(f"with {SQL_REG}, {_sql_quota('faith-', _QUOTAS)} select row_number() over (order by src_ord, \"rank\") - 1 + 100 n, i, src from quota")
def scale_draw_ids(spark, sf_dir):
    d = sampling.quota_top(gated(spark, sf_dir), _QUOTAS, "faith-")
    return sampling.numbered(d, "src_ord", "rank", start=100).select(F.col("n").cast("long").alias("n"), "i", "src")


_SQL_RARE = sampling.RARE.replace("(?iU)", "(?i)")
_RARE_WORDS = [" the Salary.", " api key", " 10-K", " bonuses", " access_token", "", ""]


@query(f"""with {SQL_REG}, t as (select i, src, fp, left(text, 100) || list_extract({_RARE_WORDS}, i % 7 + 1) text from reg),
pool as (select * from t where regexp_matches(text, '{_SQL_RARE}')), boost as (select * from pool where src in ('mail', 'pdf', 'ticket') order by sha256(fp), i limit 30)
select i, tier from (select i, 'boost' tier, row_number() over (partition by fp order by i) s from boost) where s = 1 and tier = 'boost' union all select i, 'pool' from pool where src = 'log'""")
def rare_topic_boost(spark, sf_dir):
    """The boost tier with the pattern of rare topics itself, after an empty base, and the logs that hold one, which are never boosted."""
    words = F.get(F.array(*map(F.lit, _RARE_WORDS)), (F.col("i") % 7).cast("int"))
    d = registered(spark, sf_dir).withColumn("text", F.concat(F.left("text", F.lit(100)), words))
    boost = sampling.base_and_boost(d, {"none": 1}, target=30).where("tier = 'boost'").select("i", "tier")
    return boost.unionByName(d.where((F.col("src") == "log") & F.col("text").rlike(sampling.RARE)).select("i", F.lit("pool").alias("tier")))


_SECOND = {"pdf": 12, "mail": 9, "chat": 5}
_SQL_SECOND = ", ".join(
    f"""r{k} as (select *, {k} o, row_number() over (order by sha256('more-' || fp), i) r from fresh where src = '{s}'{"".join(f" and fp not in (select fp from p{j})" for j in range(k))}), p{k} as (select * from r{k} where r <= {q})"""
    for k, (s, q) in enumerate(_SECOND.items())
)


@query(f"""with {SQL_REG}, fresh as (select * from reg where (id is null or id not in (select 'd' || doc_id from labels)) and fp not in (select 'd' || doc_id from labels)), {_SQL_SECOND}
select i, src, row_number() over (order by o, r) + 499 n from ({" union all ".join(f"select * from p{k}" for k in range(len(_SECOND)))})""")
def second_draw(spark, sf_dir):
    used = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id")).distinct()
    return sampling.second_draw(registered(spark, sf_dir), used, _SECOND, start=500).select("i", "src", F.col("n").cast("long").alias("n"))


@query("select d.doc_id i from documents d where d.doc_id not in (select doc_id from labels)")
def resume_todo(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    return catalog.todo(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i")))


def _sql_div(k: str, a: int, b: int) -> str:
    return f"(({sql_hash(k, a * b)}) // {a})"


_SQL_REGIME = f"""regimes as (select i, {sql_hash("'anchor-' || i", 100)} r, {_sql_div("'anchor-' || i", 100, 4)} + 6 k, {_sql_div("'anchor-' || i", 100, 3)} p, {_sql_div("'anchor-' || i", 100, 2)} a from reg),
regime as (select *, case when r < 25 then 'canonical' when r < 45 then 'subset' when r < 65 then 'paraphrase' when r < 85 then 'alternative' else 'none' end regime from regimes)"""
_CANON = sql_list(POOL["canonical"])


@query(f"""with {SQL_REG}, {_SQL_REGIME},
places as (select i, k, j, row_number() over (partition by i order by sha256('sub-' || i || '-' || j)) o from regime, range(14) t(j) where regime = 'subset'),
subsets as (select i, string_agg(list_extract({_CANON}, j::int + 1), ',' order by j) s from places where o <= k group by i)
select i, regime, case regime when 'canonical' then array_to_string({_CANON}, ',') when 'subset' then s
  when 'paraphrase' then array_to_string(list_extract([{", ".join(sql_list(x) for x in POOL["paraphrases"])}], p::int + 1), ',')
  when 'alternative' then array_to_string(list_extract([{", ".join(sql_list(x) for x in POOL["alternatives"])}], a::int + 1), ',') end topics from regime left join subsets using (i)""")
def anchor_topics(spark, sf_dir):
    regime, topics = hashing.anchor(F.col("i"), POOL)
    return registered(spark, sf_dir).select("i", regime.alias("regime"), F.array_join(topics, ",").alias("topics"))


@query(f"with {SQL_REG}, {_SQL_REGIME} select regime, count(*) n from regime group by regime")
def anchor_regimes(spark, sf_dir):
    return stats.counts(registered(spark, sf_dir).select(hashing.regime(F.col("i")).alias("regime")), "regime")


@query(f"""with {SQL_REG} select i, case when h < 50 then 'canonical' when h < 75 then 'none' else 'unseen:' || d end "mode", hold
from (select i, {sql_hash("'mode-' || i", 100)} h, {sql_pick("'fv-' || i", DOMAINS)} d, {sql_pick("'hold-' || i", DOMAINS)} hold from reg)""")
def conditioning_modes(spark, sf_dir):
    i = F.col("i")
    return registered(spark, sf_dir).select("i", hashing.conditioning_mode(i, DOMAINS).alias("mode"), hashing.holdout_domain(i, DOMAINS).alias("hold"))


_TEACHERS = [f"teacher_{k}" for k in range(6)]


@query(f"""with {SQL_REG}, slots as (select row_number() over (order by sha256((t.s)[1]::varchar)) - 1 slot, (t.s)[2] teacher from (select unnest([{", ".join(f"[{k}, {t}]" for k, t in enumerate(t for t, w in enumerate(hashing.PANEL_WEIGHTS) for _ in range(w)))}]) s) t)
select 'teacher_' || teacher teacher, count(*) n from reg join slots on i % 100 = slot group by 1""")
def teacher_panel(spark, sf_dir):
    return stats.counts(registered(spark, sf_dir).select(hashing.teacher(F.col("i"), _TEACHERS).alias("teacher")), "teacher")


@query(f"""with {SQL_REG} select src, count_if(s <= 35)::bigint n_eval, count_if(s > 35)::bigint n_train, min(case when s = 1 then i end) first_i from (select *, row_number() over (partition by src order by sha256(i::varchar), i) s from reg) group by src""")
def stratified_split(spark, sf_dir):
    d = sampling.stratified_split(registered(spark, sf_dir))
    first = F.min_by("i", hashing.sha_order(F.col("i")))
    return d.groupBy("src").agg(F.count_if(F.col("split") == "eval").alias("n_eval"), F.count_if(F.col("split") == "train").alias("n_train"), first.alias("first_i"))


@query(f"""with {SQL_REG} select i, case when src in ('mail', 'pdf', 'chat', 'code') then case when s <= 35 then 'eval_id' else 'train' end when s <= 100 then 'eval_ood' else 'drop' end split from (select *, row_number() over (partition by src order by sha256(i::varchar), i) s from reg)""")
def register_holdout_split(spark, sf_dir):
    return sampling.register_split(registered(spark, sf_dir), ["mail", "pdf", "chat", "code"]).select("i", "split")


@query(f"with {SQL_CARDS} select i, unnest(range(1, case when len(content_flags) = 0 and src <> 'log' then 4 else 2 end))::int as \"copy\" from cards")
def none_boost_train(spark, sf_dir):
    d = cards(spark, sf_dir)
    return sampling.oversampled(d, (F.size("content_flags") == 0) & (F.col("src") != "log"), 3).select("i", "copy")


@query(f"with {SQL_REG} select i, left(regexp_replace(regexp_replace(trim(lower(text), ' ' || chr(9) || chr(10)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) term from reg")
def norm_terms(spark, sf_dir):
    return registered(spark, sf_dir).select("i", text.norm(F.col("text")).alias("term"))


@query(f"""with {SQL_REG}, t as (select i, left(regexp_replace(regexp_replace(trim(lower(text), ' ' || chr(9) || chr(10)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) term from reg)
select i, array_to_string(list_filter(string_split(term, '_'), lambda x: x <> '' and x not in ({", ".join(f"'{s}'" for s in text.STOP)})), ' ') toks from t""")
def tokenize_terms(spark, sf_dir):
    d = registered(spark, sf_dir).select("i", text.norm(F.col("text")).alias("term"))
    return d.select("i", F.array_join(text.toks(F.col("term")), " ").alias("toks"))


@query(f"with {SQL_CARDS} select i, array_to_string(list_slice(list_transform(list_filter(list_zip(v, range(1, len(v) + 1)), lambda x: list_position(v, x[1]) = x[2]), lambda x: x[1]), 1, 12), ',') tags from (select i, list_filter(subject || [src, lang, src, ''] || content_flags, lambda x: x <> '') v from cards)")
def merge_tags(spark, sf_dir):
    d = cards(spark, sf_dir)
    tags = F.concat(F.array("src", "lang", "src", F.lit("")), F.col("content_flags"))
    return d.select("i", F.array_join(text.merge_tags(F.col("subject"), tags), ",").alias("tags"))


@query(f"with {SQL_REG}, w as (select i, list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda x: x <> '') w from reg) select i, case when len(w) > 12 then array_to_string(list_slice(w, 1, 12), ' ') || ' …' else 'whole' end cut, len(w)::int n from w")
def truncate_think(spark, sf_dir):
    n = text.word_count(F.col("text"))
    return registered(spark, sf_dir).select("i", F.when(n > 12, text.truncate_words(F.col("text"), 12)).otherwise("whole").alias("cut"), n.alias("n"))


@query(f"with {SQL_CARDS} select token, count(*) n from (select unnest(list_distinct(list_filter(string_split(s, '_'), lambda x: x <> '' and x not in ({', '.join(repr(s) for s in text.STOP)})))) token from (select unnest(subject) s from cards)) group by token")
def token_frequency(spark, sf_dir):
    return stats.token_frequency(cards(spark, sf_dir))


@query(f"with {SQL_CARDS} select token, count(*) n from (select unnest(list_distinct(string_split(s, '_'))) token from (select unnest(subject) s from cards)) group by token order by n desc, token limit 25")
def generic_tokens(spark, sf_dir):
    return stats.generic_tokens(cards(spark, sf_dir))


@query(f"""with {SQL_CARDS}, f as (select 'type' facet, "type" "value" from cards union all select 'audience', audience from cards union all select 'purpose', purpose from cards)
select facet, "value", count(*) n from f where "value" is not null group by all having count(*) >= 2""")
def facet_vocab(spark, sf_dir):
    return stats.facet_vocabulary(cards(spark, sf_dir))


@query()
def vocabulary_document(spark, sf_dir):
    return stats.vocabulary_document(cards(spark, sf_dir))


@query()
def catalog_map(spark, sf_dir):
    d = registered(spark, sf_dir).select("i", "text")
    return catalog.cards(d).select("i", "card.*")
