"""Text and JSON-text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning of their own in a term (fixed values).
STOP = ["the", "a", "an", "of", "and", "or", "for", "to", "in", "on", "with", "by"]
#: Wording that prompts already written hold, by which their topics are found again (fixed values).
ANCHOR_OPEN = "Prefer these catalog topics when they genuinely fit: "
ANCHOR_CLOSE = ". If the content"


def let(value: Column, body_: Callable[[Column], Column]) -> Column:
    """body_ over value, which is written and evaluated once however often body_ uses it."""
    return F.element_at(F.transform(F.array(value), body_), 1)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """Snake-case term of at most 40 characters; the cut comes last, so an underscore may end it."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(strip(c.cast("string"))), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(40))


def toks(term: Column) -> Column:
    """Tokens of a term without stop words; repeats stay."""
    return F.filter(F.split(term, "_"), lambda t: (t != "") & ~t.isin(STOP))


def think(content: Column, reasoning: Column | None = None) -> Column:
    """The first think block, stripped; a reasoning field wins where it says anything."""
    inline = strip(F.regexp_extract(F.coalesce(content, F.lit("")), r"(?s)<think>(.*?)</think>", 1))
    return inline if reasoning is None else F.coalesce(F.nullif(strip(reasoning), F.lit("")), inline)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def body(content: Column) -> Column:
    """Without think blocks and code fences."""
    s = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(s, r"```(?:json)?", ""))


def greedy_json(c: Column, first_key: str) -> Column:
    """From the object that opens with the key to the last brace; empty if there is none."""
    return F.regexp_extract(c, rf'(?s)\{{\s*"{first_key}"\s*:.*\}}', 0)


def lazy_json(c: Column, first_key: str) -> Column:
    """From the object that opens with the key to the first closing brace."""
    return F.regexp_extract(c, rf'(?s)\{{\s*"{first_key}"\s*:.*?\}}', 0)


def judge_json(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)


def truncate_words(c: Column, n: int) -> Column:
    """The first n words and an ellipsis where there are more; 0 keeps all."""
    if n == 0:
        return c
    w = F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(" …"))).otherwise(c)


def merge_tags(topics: Column, tags: Column, limit: int = 12) -> Column:
    empty = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.filter(F.concat(F.coalesce(topics, empty), F.coalesce(tags, empty)), lambda x: x.isNotNull() & (x != ""))), 1, limit)


def flat_view(labels: Column) -> tuple[Column, Column]:
    """(topics, tags) of labels, each in first-seen order."""
    topics = F.array_distinct(F.filter(F.transform(labels, lambda l: l["topic"]), lambda x: x.isNotNull()))
    facets = lambda l: F.array(l["scope"], l["publicity"], l["temporality"], l["specificity"], l["register_facet"])
    return topics, F.array_distinct(F.filter(F.flatten(F.transform(labels, facets)), lambda x: x.isNotNull() & (x != "")))


def recover_anchor(prompt: Column) -> Column:
    """Topics that a prompt was built with; null if it has none."""
    inner = F.substring_index(F.regexp_extract(prompt, r"(?s)\Q" + ANCHOR_OPEN + r"\E(.*)", 1), ANCHOR_CLOSE, 1)
    has = F.contains(prompt, F.lit(ANCHOR_OPEN)) & F.contains(prompt, F.lit(ANCHOR_CLOSE))
    return F.when(has, F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != ""))


def custom_id(prefix: str, i: Column, width: int = 5) -> Column:
    return F.concat(F.lit(prefix + "-"), F.when(F.length(i.cast("string")) >= width, i.cast("string")).otherwise(F.lpad(i.cast("string"), width, "0")))


def parse_custom_id(c: Column) -> Column:
    """The number behind the first hyphen; null if it is none."""
    return F.split_part(c, F.lit("-"), F.lit(2)).try_cast("bigint")


def user_turn(text: Column) -> Column:
    return F.concat(F.lit("Document:\n"), text)


def assistant_turn(thought: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>"), thought, F.lit("</think>\n"), answer)


def mode_prefix(mode: Column) -> Column:
    return F.substring_index(mode, ":", 1)


def listing(candidates: Column) -> Column:
    """One line `[k] candidate` each."""
    return F.array_join(F.transform(candidates, lambda x, k: F.concat(F.lit("["), k.cast("string"), F.lit("] "), x)), "\n")


def candidate(text: Column) -> Column:
    """The card's JSON in a sampled answer, else its first 400 characters."""
    found = lazy_json(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), "subject")
    return F.coalesce(F.nullif(found, F.lit("")), strip(F.left(text, F.lit(400))))


def clamp(number: Column, high: int | None = 3) -> Column:
    """Within 0 and high, or at least 0; null for what is no number."""
    low = lambda n: F.greatest(F.lit(0).cast("bigint"), n)
    bound = lambda n: low(n) if high is None else F.least(F.lit(high).cast("bigint"), low(n))
    return let(number.try_cast("bigint"), lambda n: F.when(n.isNotNull(), bound(n))).cast("int")


def card_json(subject, type_, audience, time, purpose, flags) -> Column:
    """The six keys in order, nulls included."""
    card = F.struct(subject.alias("subject"), type_.alias("type"), audience.alias("audience"), time.alias("time"), purpose.alias("purpose"), flags.alias("content_flags"))
    return F.to_json(card, {"ignoreNullFields": "false"})


def pretty_card(name: Column, card: Column) -> Column:
    """One readable line for each key."""
    show = lambda k: F.concat(F.lit(f"\n  {k}: "), F.coalesce(F.array_join(card[k], ", ") if k in ("subject", "content_flags") else card[k], F.lit("None")))
    return F.concat(name, *[show(k) for k in ("subject", "type", "audience", "time", "purpose", "content_flags")])
