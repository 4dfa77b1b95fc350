"""Scores of a document's chunks, from its own chunks alone: BM25, TF-IDF and the graph rankers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.cutting import Cut
from .graph import Ranker, _Batch, ranked
from .local import Docs, rows

K1, B = 1.5, 0.75  # how soon repeats stop counting, how much length counts


def rounded(x: np.ndarray, places: int = 12) -> np.ndarray:
    """To so many places, halves away from zero."""
    y = x * 10.0**places
    whole = np.trunc(y)
    return (whole + np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0)) / 10.0**places


def _scored(ready: DataFrame, keys: list[str], score: Callable[[Docs], np.ndarray], cut: Cut | None, query: str | None, lower: bool, texts: bool) -> DataFrame:
    """keys, scored array<struct<idx, score, chunk>> of documents that have a chunk. Scores are rounded to 12 places, as sums of doubles depend on their order and ties must not."""

    def run(d: Docs):
        b = d.batch
        idx = (np.arange(len(b.doc)) - b.starts[b.doc]).astype(np.int32)
        chunk = d.texts() if texts else pa.nulls(len(idx), pa.string())
        each = pa.StructArray.from_arrays([pa.array(idx), pa.array(rounded(score(d))), chunk], ["idx", "score", "chunk"])
        some = np.flatnonzero(b.chunks)
        return some, [pa.ListArray.from_arrays(pa.array(np.append(b.starts[some], len(idx)).astype(np.int32)), each)]

    return rows(ready, keys, "scored array<struct<idx:int,score:double,chunk:string>>", run, cut, query, texts, lower)


def _sums(term: Callable[[_Batch, np.ndarray], np.ndarray]) -> Callable[[Docs], np.ndarray]:
    """The sums of a term over the query's tokens if there is a query, else over all.

    Terms are added by size, so that chunks of the same terms have the same sum whatever tokens these belong to.
    """

    def score(d: Docs) -> np.ndarray:
        b = d.batch
        counts = b.wanted[b.own] | ~d.has[b.doc[b.own_chunk]]
        value, chunk = term(b, b.doc[b.own_chunk])[counts], b.own_chunk[counts]
        order = np.lexsort((value, chunk))
        return np.bincount(chunk[order], value[order], len(b.doc))

    return score


def bm25(ready: DataFrame, keys: list[str], k1: float = K1, b: float = B, cut: Cut | None = None, query: str | None = None, texts: bool = True) -> DataFrame:
    def term(t: _Batch, doc: np.ndarray) -> np.ndarray:
        n, df = t.chunks[doc], t.df[t.own]
        mean = np.bincount(t.doc, t.count, t.docs) / np.maximum(1, t.chunks)
        norm = 1 - b + b * t.count[t.own_chunk] / mean[doc]
        return np.log((n - df + 0.5) / (df + 0.5) + 1) * t.tf * (k1 + 1) / (t.tf + k1 * norm)

    return _scored(ready, keys, _sums(term), cut, query, False, texts)


def tfidf(ready: DataFrame, keys: list[str], cut: Cut | None = None, query: str | None = None, texts: bool = True) -> DataFrame:
    return _scored(ready, keys, _sums(lambda t, doc: t.tf / t.count[t.own_chunk] * np.log(t.chunks[doc] / (t.df[t.own] + 1))), cut, query, False, texts)


def graph_scores(ready: DataFrame, keys: list[str], ranker: Ranker, cut: Cut | None = None, query: str | None = None, texts: bool = True) -> DataFrame:
    """ready is from terms.prepared(), for topicrank with lower_tokens and lower_query; with cut, it has texts alone."""
    return _scored(ready, keys, lambda d: ranked(d.batch, d.low, d.has, ranker), cut, query, ranker.kind == "topicrank", texts)
