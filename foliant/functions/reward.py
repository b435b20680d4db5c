"""Reward of a card against its document: grounding, non-redundancy, register, facet prior."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let, toks

WEIGHTS = {"grounding": 0.45, "nonredundant": 0.25, "register": 0.20, "facet_prior": 0.10}


def _mean(values: Column) -> Column:
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values).cast("double")), F.lit(0.0))


def _share(values: Column, test) -> Column:
    """Share of the elements that pass; 0 for none."""
    return F.coalesce(F.try_divide(F.size(F.filter(values, test)).cast("double"), F.size(values).cast("double")), F.lit(0.0))


def grounded(token: Column, low_text: Column) -> Column:
    """In the document, or, from 5 characters on, by a stem."""
    stem = F.substring(token, F.lit(1), F.greatest(F.lit(4), F.length(token) - 3))
    return (F.length(token) >= 3) & (F.contains(low_text, token) | ((F.length(token) >= 5) & F.contains(low_text, stem)))


def grounding(subject: Column, low_text: Column) -> Column:
    """Mean share of a subject's tokens that stand in the document; low_text is taken once, not for each token."""
    return let(low_text, lambda low: _mean(F.transform(subject, lambda s: let(toks(s), lambda ts: _share(ts, lambda t: grounded(t, low))))))


def nonredundant(card: Column) -> Column:
    """1 less the mean pairwise token overlap of subjects and a quarter for each repeated value."""
    sets = F.transform(card["subject"], lambda s: F.array_distinct(toks(s)))
    overlap = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))
    pairs = F.flatten(F.transform(sets, lambda a, i: F.transform(F.filter(sets, lambda b, k: k > i), lambda b: overlap(a, b))))
    singles = F.filter(F.array(card["type"], card["audience"], card["purpose"]), lambda x: x.isNotNull())
    values = F.transform(F.concat(card["subject"], singles, card["content_flags"]), lambda x: F.lower(x))
    repeats = F.size(values) - F.size(F.array_distinct(values))
    return F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), _mean(pairs) + 0.25 * repeats))


def register(subject: Column, generic: Column, known: Column) -> Column:
    """Shape, specificity and known vocabulary of each subject."""

    def one(s: Column) -> Column:
        t = toks(s)
        shape = F.when(F.size(t).between(2, 4), 1.0).when(F.size(t) == 1, 0.4).otherwise(0.6)
        special = F.exists(t, lambda x: ~F.array_contains(generic, x)).cast("double")
        return F.when(F.size(t) == 0, 0.0).otherwise(0.4 * shape + 0.35 * special + 0.25 * _share(t, lambda x: F.array_contains(known, x)))

    return _mean(F.transform(subject, one))


def facet_prior(card: Column, vocabulary: dict[str, Column]) -> Column:
    """Mean over type, audience and purpose; vocabulary holds an array column for each."""

    def one(k: str) -> Column:
        value, known = card[k], vocabulary[k]
        tokens = F.flatten(F.transform(known, toks))
        return F.when(value.isNull() | (value == ""), 0.3).when(F.array_contains(known, value), 1.0).otherwise(0.5 * _share(toks(value), lambda x: F.array_contains(tokens, x)))

    return (one("type") + one("audience") + one("purpose")) / 3.0


def total(card: Column, parts: dict[str, Column]) -> Column:
    score = sum((WEIGHTS[k] * parts[k] for k in WEIGHTS), F.lit(0.0))
    return F.when(card.isNull(), 0.0).otherwise(score)


def completion_text(completion: Column, chat: bool = False) -> Column:
    """The text of a completion: a string, or with `chat` the first message of a list of structs with content."""
    return F.get(completion, F.lit(0))["content"] if chat else completion


def scored(completion: Column, document: Column, generic: Column, known: Column, vocabulary: dict[str, Column], chat: bool = False) -> Column:
    """Reward of each completion for its document, as a trainer asks for it: 0 for a completion that is no card."""
    from foliant.functions.gates import card_gate

    low = F.lower(document)

    def of(card: Column) -> Column:
        parts = {"grounding": grounding(card["subject"], low), "nonredundant": nonredundant(card), "register": register(card["subject"], generic, known), "facet_prior": facet_prior(card, vocabulary)}
        return total(card, parts)

    return let(card_gate(completion_text(completion, chat)), of)
