"""Vectors of texts, by any function; batches of ten as a service would take them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

BATCH = 10


def embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> Callable[[Column], Column]:
    """A function from a string column to array<float>. embed gets at most `batch` texts a call; what it leaves out is empty."""

    ship(SparkSession.active())

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            for i in range(0, len(texts), batch):
                some = texts.iloc[i : i + batch].fillna("").tolist()
                got = list(embed(some) or [])
                out += (got + [[]] * len(some))[: len(some)]
            yield pd.Series(out, index=texts.index)

    return run


def hashed(dimension: int = 128) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in without a model: counts of words by hash."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % dimension] += 1.0
            out.append(v)
        return out

    return embed


def print_embeddings(texts: list[str], embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> None:
    """Each text with its vector, on the screen."""
    for i in range(0, len(texts), batch):
        for text, vector in zip(texts[i : i + batch], embed(texts[i : i + batch])):
            print(text, vector)
