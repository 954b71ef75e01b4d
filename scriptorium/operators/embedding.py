"""Embedding operators (U01-U07) with an injected provider; the vocabulary embedder is plain columns."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from functools import reduce

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The vocabulary and its dimensions of the test embedder.
VOCABULARY = {
    "HTTP": 0, "REQUEST": 1, "RESPONSE": 2, "HEADER": 3, "METHOD": 4,
    "TLS": 50, "HANDSHAKE": 51, "CERTIFICATE": 52, "CIPHER": 53, "RECORD": 54,
    "URI": 100, "PATH": 101, "QUERY": 102, "SCHEME": 103, "AUTHORITY": 104,
    "QUIC": 150, "PACKET": 151, "STREAM": 152, "FLOW": 153, "TRANSPORT": 154,
    "MUST": 200, "SHOULD": 201, "REQUIRE": 202, "NORMATIVE": 203, "RFC": 204,
    "TCP": 250, "CONGESTION": 251, "WINDOW": 252, "RETRANSMISSION": 253, "CWND": 254,
    "DNS": 300, "DOMAIN": 301, "SERVER": 302, "RESOLUTION": 303, "SOA": 304,
}

Provider = Callable[[list[str]], list[Sequence[float]]]


class Retryable(Exception):
    """A failure worth another attempt; ``after`` is the provider's wish in seconds or as an HTTP date."""

    def __init__(self, reason: str, after: str | None = None) -> None:
        super().__init__(reason)
        self.after = after


WIDTH = max(VOCABULARY.values()) + 1


def vocabulary_vector(text: Column | str, width: int = WIDTH, words: dict[str, int] | None = None) -> Column:
    """A vector of ``width`` numbers; a word that the text holds is 1 at its dimension (modulo the width), else all is
    0, and the whole is scaled to length 1, if any word is there."""
    upper = F.upper(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    at: dict[int, Column] = {}
    for word, place in (words or VOCABULARY).items():
        held = F.contains(upper, F.lit(word)).cast("double")
        at[place % width] = F.greatest(at[place % width], held) if place % width in at else held
    length = F.sqrt(reduce(lambda a, b: a + b, at.values()))
    return F.array(*(F.coalesce(F.try_divide(at[i], length), F.lit(0.0)) if i in at else F.lit(0.0) for i in range(width)))


def vocabulary_provider(width: int = WIDTH, words: dict[str, int] | None = None) -> Provider:
    """The same vectors as a provider, for runs without a model."""
    table = words or VOCABULARY

    def vectors(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            upper = (text or "").upper()
            held = {place % width for word, place in table.items() if word in upper}
            out.append([len(held) ** -0.5 if i in held else 0.0 for i in range(width)])
        return out

    return vectors


def is_retryable(status: int | None) -> bool:
    """Timeouts, throttling, server errors, and failures without a status."""
    return status is None or status in (408, 429) or 500 <= status < 600


def delay(attempt: int, after: str | None, now: datetime | None = None, roll: Callable[[], float] = random.random) -> float:
    """The provider's wish, else a random part of 2 ** attempt seconds; at most 30."""
    if after:
        try:
            wish = float(after)
        except ValueError:
            try:
                wish = (parsedate_to_datetime(after) - (now or datetime.now(timezone.utc))).total_seconds()
            except (TypeError, ValueError):
                wish = 0.0
        return max(0.0, min(30.0, wish))
    return roll() * min(30.0, 2.0**attempt)


def embed_batch(provider: Provider, texts: list[str], width: int, attempts: int = 3, sleep: Callable[[float], None] = time.sleep, counted: Callable[[str], None] = lambda name: None) -> list[list[float]]:
    """Vectors of a batch; an empty answer is asked for one by one, and still empty is a zero vector. ``counted``
    is told of each batch and retry (U06)."""
    for attempt in range(1, attempts + 1):
        try:
            counted("batches")
            got = provider(texts)
            if not got and len(texts) > 1:
                return [embed_batch(provider, [t], width, attempts, sleep, counted)[0] for t in texts]
            if not got or (len(got) == 1 and not len(got[0])):
                return [[0.0] * width for _ in texts]
            if len(got) != len(texts):
                raise Retryable(f"{len(got)} vectors for {len(texts)} texts")
            if any(len(v) != width for v in got):
                raise ValueError(f"a vector hasn't {width} numbers")
            return [list(map(float, v)) for v in got]
        except Retryable as failure:
            if attempt == attempts:
                raise
            counted("retries")
            sleep(delay(attempt, failure.after))
    raise AssertionError


def embed(df: DataFrame, provider: Provider, width: int, key: str = "id", text: str = "text", batch: int = 10, concurrency: int | None = None, counted: dict[str, Accumulator] | None = None) -> DataFrame:
    """(key, embedding) in batches, in order; ``concurrency`` bounds how many tasks call the provider at once.

    Batches and retries are counted in the accumulators of :func:`counters` if given.
    """

    def count(name: str) -> None:
        if counted is not None:
            counted[name].add(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t or "" for t in rows.column(1).to_pylist()]
            vectors = [v for a in range(0, len(texts), batch) for v in embed_batch(provider, texts[a : a + batch], width, counted=count)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(vectors, pa.list_(pa.float32()))], [key, "embedding"])

    chosen = df.select(key, text)
    if concurrency:
        chosen = chosen.repartition(concurrency)
    return chosen.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>")


def counters(spark: SparkSession) -> dict[str, Accumulator]:
    """Accumulators for batches and retries."""
    return {name: spark.sparkContext.accumulator(0) for name in ("batches", "retries")}
