"""Requests, training sets, gold sets and judge prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ANCHOR_CLOSE, ANCHOR_OPEN, assistant_turn, card_json, custom_id, listing, merge_tags, recover_anchor, user_turn

#: Characters of the document in each kind of prompt.
CUTS = {"manifest": 4000, "judge": 3500, "rank": 3000, "match": 900}
SYSTEM = {
    "closed": "Read the document and list what it is about. Think first inside <think> tags, then answer with JSON of the form {\"labels\": [...]}, topics and facets from the closed lists only.",
    "openvocab": "Read the document and name its topics and tags in your own terms. Think first inside <think> tags, then answer with JSON of the form {\"topics\": [...], \"tags\": [...]}.",
    "faceted": "Fill in a catalog card for the document: subject (1 to 3), type, audience, time, purpose, content_flags (up to 3). Think first inside <think> tags, then answer with the card as JSON.",
    "student": "Fill in a catalog card for the document: subject (1 to 3), type, audience, time, purpose, content_flags (up to 3). Answer with the card as JSON.",
    "tags": "Name up to twelve tags for the document. Answer with JSON of the form {\"tags\": [...]}.",
    "direct": "Read the document and name its topics and tags in your own terms. Answer at once with JSON of the form {\"topics\": [...], \"tags\": [...]}.",
    "flat": "Read the document and give one flat list of topics from the closed list. Answer with JSON of the form {\"topics\": [...]}.",
    "none": "Read the document. Where none of the listed topics fits, answer with an empty list of topics rather than with a near miss.",
    "teacher": "Fill in a catalog card for the document as a careful librarian would: only what the text itself supports. Answer with the card as JSON.",
}


def prompt(base: str, anchor: Column | None = None) -> Column:
    """System prompt; a list of topics adds a clause, none or an empty one doesn't."""
    text = F.lit(base)
    if anchor is None:
        return text
    clause = F.concat(F.lit(" " + ANCHOR_OPEN), F.array_join(anchor, ", "), F.lit(ANCHOR_CLOSE + " needs another, name it."))
    return F.concat(text, F.when(F.size(F.coalesce(anchor, F.array().cast("array<string>"))) > 0, clause).otherwise(F.lit("")))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def requests(df: DataFrame, prefix: str, system: Column, model: str = "judge", text: Column | None = None, width: int = 5, most_tokens: int = 2000) -> DataFrame:
    """custom_id, method, url, body of batch requests over rows with i and text."""
    text = F.left(F.col("text"), F.lit(CUTS["manifest"])) if text is None else text
    messages = F.array(message("system", system), message("user", user_turn(text)))
    return df.select(custom_id(prefix, F.col("i"), width).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(most_tokens).alias("max_completion_tokens")).alias("body"))


def answers(responses: DataFrame) -> DataFrame:
    """i and content of batch responses."""
    from foliant.functions.text import parse_custom_id

    content = F.get("response.body.choices", F.lit(0))["message"]["content"]
    return responses.select(parse_custom_id(F.col("custom_id")).alias("i"), content.alias("content"))


def with_manifest(answered: DataFrame, manifest: DataFrame, key: str = "i") -> tuple[DataFrame, DataFrame]:
    """Answers joined with their documents, and the answers that have none, which no consumer may pass over."""
    return answered.join(manifest, key), answered.join(manifest.select(key), key, "left_anti")


def tag_counts(judged: DataFrame, preds: DataFrame | None, key: str = "i") -> DataFrame:
    """Adds n_tags: those of the prediction, 0 where there is none; null for all without predictions."""
    if preds is None:
        return judged.withColumn("n_tags", F.lit(None).cast("int"))
    counted = preds.select(key, F.size(F.coalesce("tags", F.array().cast("array<string>"))).alias("n_tags"))
    return judged.join(counted, key, "left").withColumn("n_tags", F.coalesce("n_tags", F.lit(0)))


def tags_only(df: DataFrame, system: str) -> DataFrame:
    """messages with topics and tags merged into tags, and the topics of the old prompt kept; rows without any tag are dropped."""
    merged = df.withColumn("_tags", merge_tags(F.col("topics"), F.col("tags"))).where(F.size("_tags") > 0)
    messages = F.array(message("system", prompt(system, recover_anchor(F.col("system")))), message("user", F.col("user")), message("assistant", F.to_json(F.struct(F.col("_tags").alias("tags")))))
    return merged.select(messages.alias("messages"), "src", "i")


def latest(df: DataFrame, key: str = "i", position: str = "pos") -> DataFrame:
    """The last row of each key in file order; aggregated before it is shuffled, so that a frequent key is one row of each task."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), position).alias("_last")).select("_last.*")


def positional(left: DataFrame, right: DataFrame, *order_left, order_right=None, head: int = 0) -> DataFrame:
    """Rows joined by their place; both sides must be of one length. With `head`, the first so many rows of either."""
    number = lambda df, *o: df.withColumn("pos", F.row_number().over(Window.orderBy(*o)) - 1)
    a, b = number(left, *order_left), number(right, *(order_right or order_left))
    if head:
        a, b = a.where(F.col("pos") < head), b.where(F.col("pos") < head)
    if a.count() != b.count():
        raise ValueError("both sides must have as many rows")
    return a.join(b, "pos")


def with_anchors(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """Left join on i; without an anchor row the regime is none."""
    return df.join(anchors, "i", "left").withColumn("regime", F.coalesce("regime", F.lit("none")))


def sft(df: DataFrame, system: Column, thought: Column | None, answer: Column, *keep: str) -> DataFrame:
    """messages of system, user and assistant, and the kept columns."""
    reply = answer if thought is None else assistant_turn(thought, answer)
    messages = F.array(message("system", system), message("user", user_turn(F.col("text"))), message("assistant", reply))
    return df.select(messages.alias("messages"), *keep)


def card_answer(card: Column) -> Column:
    return card_json(*[card[k] for k in ("subject", "type", "audience", "time", "purpose", "content_flags")])


def judge_prompt(text: Column, card: Column) -> Column:
    """Faithfulness prompt over a faceted card."""
    return F.concat(F.lit("Judge each field of the card against the document alone.\nCard: "), card_answer(card), F.lit("\nDocument:\n"), F.left(text, F.lit(CUTS["judge"])))


def topics_judge_prompt(text: Column, topics: Column, tags: Column) -> Column:
    return F.concat(F.lit("Grade each topic as precise, vague or wrong, and count the apt tags.\nTopics: "), F.to_json(topics), F.lit("\nTags: "), F.to_json(tags), F.lit("\nDocument:\n"), F.left(text, F.lit(CUTS["judge"])))


def tags_judge_prompt(text: Column, tags: Column) -> Column:
    """Faithfulness prompt over one flat list of tags."""
    return F.concat(F.lit("Grade each tag as precise, vague or wrong for the document alone, and count clear subjects that no tag covers.\nTags: "), F.to_json(tags), F.lit("\nDocument:\n"), F.left(text, F.lit(CUTS["judge"])))


def rank_prompt(text: Column, candidates: Column) -> Column:
    return F.concat(F.lit("Rank the cards from best to worst and score each from 0 to 10.\n"), listing(candidates), F.lit("\nDocument:\n"), F.left(text, F.lit(CUTS["rank"])))


def match_prompt(text: Column, gold: Column, pred: Column) -> Column:
    return F.concat(F.lit("How many predicted topics mean the same as a gold one?\nGold: "), F.to_json(gold), F.lit("\nPredicted: "), F.to_json(pred), F.lit("\nDocument:\n"), F.left(text, F.lit(CUTS["match"])))


def idempotent_append(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union in which rows of new replace those with their key, so that repeating it changes nothing."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
