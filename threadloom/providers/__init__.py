"""Model providers: small interfaces with deterministic offline defaults.

A provider is any picklable object with the method of its protocol; it is called with a batch at a time on the executors.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hashed_vector
from ..functions.tokens import words_of


class Embedder(Protocol):
    """embed() is called with batches of texts; a provider with column() instead gives an expression."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Model(Protocol):
    def complete(self, prompts: list[str]) -> list[str | None]: ...


@dataclass
class HashingEmbedder:
    """Words hashed into counts of unit length, as an expression: the same text, the same vector, everywhere. dim is a power of 16."""

    dim: int = 256

    def column(self, text: Column) -> Column:
        return hashed_vector(words_of(text, r"(?U)\w+"), self.dim).cast("array<float>")


@dataclass
class FirstSentence:
    """An offline stand-in for a text model: the prompt's first sentence."""

    limit: int = 400

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [re.split(r"(?<=[.!?])\s", (p or "").strip(), maxsplit=1)[0][: self.limit] or None for p in prompts]


@dataclass
class Retrying:
    """A provider's call with exponential waits and jitter, and at least so many seconds between calls."""

    call: Callable[[list[str]], list]
    tries: int = 3
    base_s: float = 1.0
    least_gap_s: float = 0.0
    sleep: Callable[[float], None] = time.sleep
    seed: int = 0
    _last: float = field(default=0.0, repr=False)

    def __call__(self, batch: list[str]) -> list:
        rng = random.Random(self.seed)
        for n in range(self.tries):
            wait = self._last + self.least_gap_s - time.monotonic()
            if self.least_gap_s and wait > 0:
                self.sleep(wait)
            self._last = time.monotonic()
            try:
                return self.call(batch)
            except Exception:
                if n + 1 == self.tries:
                    raise
                self.sleep(self.base_s * 2**n * (1 + rng.random() / 4))
        return []


def _mapped(df: DataFrame, column: str, out: str, kind: str, call: Callable[[list[str]], list], batch: int) -> DataFrame:
    schema = df.select("*", F.lit(None).cast(kind).alias(out)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = pdf[column].tolist()
            results = [x for i in range(0, len(values), batch) for x in call(values[i : i + batch])]
            yield pdf.assign(**{out: results})

    return df.mapInPandas(run, schema)


def embedded(df: DataFrame, column: str, embedder: Embedder, out: str = "embedding", batch: int = 16, concurrency: int | None = None) -> DataFrame:
    """df with vectors of a text column, in batches; concurrency bounds how many calls run at once."""
    if hasattr(embedder, "column"):
        return df.withColumn(out, embedder.column(F.col(column)))
    df = df.repartition(concurrency) if concurrency else df
    return _mapped(df, column, out, "array<float>", embedder.embed, batch)


def completed(df: DataFrame, prompt: str, model: Model, out: str = "reply", batch: int = 8, cache: DataFrame | None = None, concurrency: int | None = None) -> DataFrame:
    """df with replies to a prompt column; each distinct prompt is asked once, and not at all where the cache (prompt, reply) has it."""
    asked = df.select(F.col(prompt).alias("prompt")).distinct()
    known = None
    if cache is not None:
        known = cache.select("prompt", "reply")
        asked = asked.join(known.select("prompt"), "prompt", "left_anti")
    asked = asked.repartition(concurrency) if concurrency else asked
    replies = _mapped(asked, "prompt", "reply", "string", model.complete, batch)
    replies = replies if known is None else replies.unionByName(known)
    return df.join(replies.select(F.col("prompt").alias(prompt), F.col("reply").alias(out)), prompt, "left")
