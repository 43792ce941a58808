"""Pluggable model interfaces with deterministic defaults."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Chat = Callable[[list[str]], list["str | None"]]


def hashing_embedder(width: int = 128, signed: bool = True) -> Embedder:
    """Hashed bag of words, normalised: deterministic and without a model. Signed, two words of a text that meet in a slot can cancel each
    other; unsigned, they only add up, so texts that share words never look less alike than their words are."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * width
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % width] += 1.0 if h >> 63 or not signed else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def embed(column: Column, embedder: Embedder | None = None) -> Column:
    """Vectors of a text column; the model is made once per task."""
    model = embedder or hashing_embedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model([x or "" for x in s]))

    return run(column)


def ask(column: Column, chat: Chat | None = None) -> Column:
    """Answers to prompts; null without a model."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None] * len(s) if chat is None else chat(list(s)), dtype=object)

    return run(column)


def answers(df: DataFrame, prompt: Column, schema: str, chat: Chat | None = None) -> DataFrame:
    """Structured answers: JSON is parsed by schema, malformed answers are null."""
    return df.withColumn("answer", F.from_json(ask(prompt, chat), schema))
