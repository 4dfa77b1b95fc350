"""What is computed of each document by itself: an Arrow function cuts, tokenises and counts, and gives rows.

A document's chunks, counts and graph depend on its own text alone, so texts go to Python once, as they are read, and only results
come back: no tokens are exchanged. Documents are taken a bounded number of characters at once, as arrays of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.cutting import Chunks, Cut, tokens
from ..ship import ship
from .graph import _Batch, _flat

_CHARACTERS = 1 << 20  # bytes of documents that are taken at once, or one longer document
_ROWS = 1 << 17  # of results in a batch


class Docs:
    """Some documents: `batch` has their tokens, `low` those of the texts in lower case, `has` whether they have a query."""

    def __init__(self, batch: _Batch, low: _Batch | None, has: np.ndarray, texts: Callable[[], pa.Array]):
        self.batch, self.low, self.has, self.texts = batch, low, has, texts


@lru_cache(4096)
def _asked(query: str, stopwords: frozenset[str]) -> list[str]:
    return list(dict.fromkeys(tokens(query, stopwords)))


def _numbers(chunks: Chunks, cut: Cut, queries: list[str], has: np.ndarray, lower: bool) -> _Batch:
    names, code, begin = chunks.tokens(cut, lower)
    asked = [_asked(q.lower() if lower else q, cut.stopwords) for q in queries]
    all_, query_code = names, np.zeros(0, np.int64)
    if any(asked):  # a query's other words come last; no chunk has them
        place = {w: i for i, w in enumerate(names)}
        query_code = np.array([place.setdefault(w, len(place)) for q in asked for w in q], np.int64)
        all_ = list(place)
    first, last = begin[chunks.ranges[:, 0]], begin[chunks.ranges[:, 1] + 1]
    size = last - first
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    n = sum(chunks.count)
    return _Batch(np.array(chunks.count, np.int64), np.bincount(chunks.chunk, size, n).astype(np.int64), code[at], all_, np.fromiter(map(len, asked), np.int64, len(asked)), query_code, has)


def _cut(texts: list[str | None], queries: list[str | None], cut: Cut, lower: bool) -> Docs:
    chunks, has = Chunks(texts, cut), np.array([bool(q) for q in queries], bool)
    asked = [q or "" for q in queries]
    return Docs(_numbers(chunks, cut, asked, has, False), _numbers(chunks, cut, asked, has, True) if lower else None, has, lambda: pa.array(chunks.texts(), pa.string()))


def _given(b: pa.RecordBatch, lower: bool) -> Docs:
    has = np.asarray(b["has_query"].fill_null(False), bool)
    low = _Batch.nested(b["lower_tokens"], b["lower_query"], has) if lower else None
    return Docs(_Batch.nested(b["chunk_tokens"], b["query_tokens"], has), low, has, lambda: b["chunks"].flatten())


def _slices(weight: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose weights add up to _CHARACTERS at most; one row at least."""
    upto, i = np.concatenate([[0], np.cumsum(weight)]), 0
    while i < len(weight):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + _CHARACTERS, side="right")) - 1)
        yield i, j
        i = j


def rows(df: DataFrame, keys: list[str], results: str, run: Callable[[Docs], tuple[np.ndarray, list]], cut: Cut | None = None, query: str | None = None, texts: bool = False, lower: bool = False) -> DataFrame:
    """keys and results (a schema): the rows that run makes of some documents, given the document of each (rising) and the columns.

    With cut, df has a column text and perhaps one with its query; without, it is from terms.prepared(), and `texts` and `lower` say
    whether chunks, and tokens in lower case, are wanted.
    """
    ship(df.sparkSession)
    if cut:
        columns = ["text", *([query] if query else [])]
    else:
        columns = ["chunk_tokens", "query_tokens", "has_query", *(["chunks"] if texts else []), *(["lower_tokens", "lower_query"] if lower else [])]
    columns = list(dict.fromkeys([*keys, *columns]))
    d = df.select(*columns)
    schema = ", ".join([*(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys), results])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if cut:
                text, asked = b["text"], b[query] if query else pa.nulls(len(b), pa.string())
                weight = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                upto = np.concatenate([[0], np.cumsum(_flat(b["chunk_tokens"].flatten()))])
                weight = 6 * np.diff(upto[np.concatenate([[0], np.cumsum(_flat(b["chunk_tokens"]))])])
            for i, j in _slices(weight):
                part = b.slice(i, j - i)
                docs = _cut(text.slice(i, j - i).to_pylist(), asked.slice(i, j - i).to_pylist(), cut, lower) if cut else _given(part, lower)
                at, made = run(docs)
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
                for k in range(0, len(at), _ROWS):
                    some = pa.array(at[k : k + _ROWS])
                    yield pa.RecordBatch.from_arrays([*(part[c].take(some) for c in keys), *(x.slice(k, _ROWS) for x in made)], names=out)

    out = [*keys, *(x.split()[0] for x in results.split(", "))] if "<" not in results else [*keys, results.split()[0]]
    return d.mapInArrow(each, schema)
