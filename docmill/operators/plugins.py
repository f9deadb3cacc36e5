"""Swap points for models: embedding, reranking, recognition, answering.

None of them ships with the engine.  A plug-in is a plain function on a batch; it is
loaded once in each Python worker and called on Arrow batches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.workers import ship

BATCH = 32

Embedder = Callable[[list[str]], list[list[float]]]
Recogniser = Callable[[bytes, str], str]


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in for tests: signed counts of hashed words, of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def embed_column(text: Column, make: Callable[[], Embedder]) -> Column:
    """Embeds in batches of 32; ``make`` loads the model, once a task."""
    ship(SparkSession.active())

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), BATCH) for v in embed(texts[i : i + BATCH])], index=s.index)

    return run(text)


def rerank_with(score: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[DataFrame, str], DataFrame]:
    """A reranker from a function on (query, text) pairs."""

    def apply(hits: DataFrame, query: str) -> DataFrame:
        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(score([(query, t) for t in texts.fillna("")]), dtype="float64")

        return hits.withColumn("rerank_score", run("text"))

    return apply


def recognise_column(image: Column, name: Column, engines: list[Recogniser]) -> Column:
    """Text of an image by the first engine that gives any; an engine that raises is off for the task."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        alive = list(engines)
        for images, names in batches:
            out = []
            for data, n in zip(images, names, strict=True):
                text = ""
                for engine in list(alive):
                    try:
                        text = (engine(data, n) or "").strip()
                    except Exception:
                        alive.remove(engine)
                    if text:
                        break
                out.append(text)
            yield pd.Series(out, index=images.index, dtype="object")

    return run(image, name)


def segment_column(text: Column, make: Callable[[], Callable[[str], list[str]]]) -> Column:
    """Words of a text by a segmenter, which ``make`` loads (and gives its own words) once a task."""
    ship(SparkSession.active())

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = make()
        for s in batches:
            yield pd.Series([list(cut(t)) for t in s.fillna("")], index=s.index, dtype="object")

    return run(text)
