"""Cards for documents by a model that is plugged in: batches in, one answer out for each document."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.gates import cli_card


class Cataloger(Protocol):
    """Made once in each task; turns a batch of texts into as many answers."""

    def __call__(self, texts: list[str]) -> list[str]: ...


class RuleCataloger:
    """Stands in for a model: the three most frequent long words are the subjects."""

    def __call__(self, texts: list[str]) -> list[str]:
        import json
        import re
        from collections import Counter

        out = []
        for t in texts:
            words = Counter(re.findall(r"[a-z]{6,}", t.lower()))
            subject = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:3]]
            out.append(json.dumps({"subject": subject, "type": None, "audience": None, "time": None, "purpose": None, "content_flags": []}))
        return out


def generate(docs: DataFrame, make: Callable[[], Cataloger], id_col: str = "i", text_col: str = "text", batch: int = 8, max_chars: int = 4000, copies: int = 1) -> DataFrame:
    """id and answers (array of `copies`) of each document, in input order within partitions; the model is made once a task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            texts, answers = frame["text"].fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                rounds = [model(texts[at : at + batch]) for _ in range(copies)]
                answers += [list(a) for a in zip(*rounds, strict=True)]
            yield pd.DataFrame({id_col: frame[id_col], "answers": answers})

    return docs.select(id_col, F.left(F.col(text_col), F.lit(max_chars)).alias("text")).mapInPandas(run, f"{id_col} {kind}, answers array<string>")


def cards(docs: DataFrame, make: Callable[[], Cataloger] = RuleCataloger, **options) -> DataFrame:
    """id and card (six keys, or error and raw) of each document."""
    out = generate(docs, make, **options)
    return out.select(out.columns[0], cli_card(F.get("answers", F.lit(0))).alias("card"))


def called(df: DataFrame, call: Callable[[str], tuple[int, str]], prompt_col: str = "prompt", id_col: str = "i", attempts: int = 4, threads: int = 10, pause: float = 2.0) -> DataFrame:
    """id, ok, answer, reason: a remote call for each prompt with retries on 429 and 5xx; calls that never succeed are reject rows."""
    kind = df.schema[id_col].dataType.simpleString()

    def one(prompt: str):
        for n in range(attempts):
            try:
                status, answer = call(prompt)
            except Exception as e:  # noqa: BLE001  a call's failure is a result
                return False, None, f"err:{type(e).__name__}"
            if status == 200:
                return True, answer, None
            if status != 429 and status < 500:
                return False, None, f"err:{status}"
            if n + 1 < attempts:
                time.sleep(pause * (n + 1))
        return False, None, "err:exhausted"

    def run(frames):
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                rows = list(pool.map(one, frame[prompt_col]))
                yield pd.DataFrame({id_col: frame[id_col], "ok": [r[0] for r in rows], "answer": [r[1] for r in rows], "reason": [r[2] for r in rows]})

    return df.select(id_col, prompt_col).mapInPandas(run, f"{id_col} {kind}, ok boolean, answer string, reason string")


def todo(docs: DataFrame, attempted: DataFrame, key: str = "i", limit: int = 0) -> DataFrame:
    """Documents that were not attempted yet; the first `limit` by key if it isn't 0."""
    out = docs.join(attempted.select(key).distinct(), key, "left_anti")
    return out.orderBy(key).limit(limit) if limit else out


def judged_or_zero(matched: Column) -> Column:
    """A judge's match count; a failed judgement counts none."""
    return F.coalesce(matched, F.lit(0))
