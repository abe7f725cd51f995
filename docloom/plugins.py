"""Models as plug-ins: embedding, reranking, completion. The ones here are deterministic and need no service.

A plug-in works on pandas batches. Rules that can answer come first: rows they answer never reach Python
(:func:`ask_if_unknown`), and equal texts are embedded once (:func:`embed`).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text that an embedding sees.
EMBED_CHARS = 8000


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: pd.Series) -> pd.Series: ...


class HashingEmbedder:
    """Hashed word counts, length 1; all zero for a text without words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def one(self, text: str | None) -> list[float]:
        v = [0.0] * self.dim
        for w in re.findall(r"\w+", (text or "")[:EMBED_CHARS].lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def __call__(self, texts: pd.Series) -> pd.Series:
        return texts.map(self.one)


def overlap_reranker(query: str) -> Callable[[pd.Series], pd.Series]:
    """Scores texts by the words they share with the query."""
    words = set(re.findall(r"\w+", query.lower()))
    return lambda texts: texts.map(lambda t: float(len(words & set(re.findall(r"\w+", (t or "").lower())))) - 1.0)


def rule_completer(prompts: pd.Series) -> pd.Series:
    """Answers ``no``: what callers take an unreachable model to have said."""
    return prompts.map(lambda _: "no")


def embed(df: DataFrame, text: str, out: str = "embedding", embedder: Embedder | None = None) -> DataFrame:
    """``df`` plus a vector per text; each distinct text is embedded once, null texts get null."""
    model = embedder or HashingEmbedder()
    udf = F.pandas_udf(lambda s: model(s), "array<float>")
    vectors = df.select(F.col(text).alias("__t")).filter("__t is not null").distinct().select("__t", udf("__t").alias(out))
    return df.join(vectors, df[text] == vectors["__t"], "left").drop("__t")


def rerank(df: DataFrame, text: str, scorer: Callable[[pd.Series], pd.Series], out: str = "rerank") -> DataFrame:
    return df.withColumn(out, F.pandas_udf(lambda s: scorer(s), "double")(text))


def ask_if_unknown(df: DataFrame, answer: str, prompt: str, completer: Callable[[pd.Series], pd.Series] = rule_completer) -> DataFrame:
    """Rows whose rule gave null are asked of the model; the others are not sent to it."""
    udf = F.pandas_udf(lambda s: completer(s), "string")
    known = df.filter(F.col(answer).isNotNull())
    return known.unionByName(df.filter(F.col(answer).isNull()).withColumn(answer, F.lower(udf(prompt))))


def with_retries(call: Callable[[str], str], tries: int = 10, pause: float = 1.0, on: Sequence[type[Exception]] = (OSError, TimeoutError)) -> Callable[[pd.Series], pd.Series]:
    """A completer of a service call: retried, and an empty answer once the tries are used up."""
    import time

    def one(prompt: str) -> str:
        for i in range(tries):
            try:
                return call(prompt)
            except tuple(on):
                if i + 1 < tries:
                    time.sleep(pause)
        return ""

    return lambda prompts: prompts.map(one)
