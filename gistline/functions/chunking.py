"""Packing segments into overlapping chunks: as an Arrow function, and as an expression, a fold over segment lengths that carries integers alone."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .cutting import OVERLAP, SHORT_TAIL, Chunks, Cut
from .text import ENDINGS, segments, weighted_length


def chunk_ranges(lengths: Column, most: int, overlap: int = OVERLAP) -> Column:
    """array<struct<a int, b int>>: first and last segment (from 0) of each chunk.

    Segments are packed while their lengths add up to at most `most`. The next chunk then begins with the last segments of this
    one, as many as have `overlap` at most together, but one at least. A longer segment is a chunk by itself.
    """
    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("c"), none.alias("out"))
    pair = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))

    def back(s, i):
        """First segment and length of the overlap before i, within the chunk that began at s."""
        before = F.reverse(F.slice(lengths, s + 1, i - s))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(True).alias("open"))

        def take(t, x):
            ok = t["open"] & ((t["n"] == 0) | (t["c"] + x <= overlap))
            return F.struct((t["n"] + ok.cast("int")).alias("n"), (t["c"] + F.when(ok, x).otherwise(0)).alias("c"), ok.alias("open"))

        return F.aggregate(before, zero, take)

    def step(t, i):
        x = F.get(lengths, i)
        s, c, out = t["s"], t["c"], t["out"]
        flushed = F.when(s < i, F.concat(out, pair(s, i - 1))).otherwise(out)
        lap = back(s, i)
        alone = F.struct((i + 1).alias("s"), F.lit(0).alias("c"), F.concat(flushed, pair(i, i)).alias("out"))
        new = F.struct((i - lap["n"]).alias("s"), (lap["c"] + x).alias("c"), flushed.alias("out"))
        same = F.struct(s.alias("s"), (c + x).alias("c"), out.alias("out"))
        return F.when(x > most, alone).when((s < i) & (c + x > most), new).otherwise(same)

    n = F.size(lengths)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda t: F.when(t["s"] < n, F.concat(t["out"], pair(t["s"], n - 1))).otherwise(t["out"]))


def chunks_of(segs: Column, ranges: Column) -> Column:
    """array<string>: the chunks' texts, segments joined by blanks."""
    return F.transform(ranges, lambda r: F.array_join(F.slice(segs, r["a"] + 1, r["b"] - r["a"] + 1), " "))


def merge_tail(texts: Column) -> Column:
    """A last chunk of weighted length under SHORT_TAIL is added to the one before."""
    n = F.size(texts)
    short = (n >= 2) & (weighted_length(F.try_element_at(texts, F.lit(-1))) < SHORT_TAIL)
    last = F.concat(F.try_element_at(texts, F.lit(-2)), F.lit(" "), F.try_element_at(texts, F.lit(-1)))
    return F.when(short, F.concat(F.slice(texts, 1, F.greatest(n - 2, F.lit(0))), F.array(last))).otherwise(texts)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used, and however the optimizer moves the whole."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(text: Column | str, most: int = 150, overlap: int = OVERLAP, **how) -> Column:
    """array<string>: the text's chunks; empty for a null or a text without a segment."""
    pack = lambda segs: let(F.transform(segs, weighted_length), lambda n: let(chunk_ranges(n, most, overlap), lambda r: let(chunks_of(segs, r), merge_tail)))
    return let(segments(text, most, **how), pack)


def with_chunks(df: DataFrame, text: str = "text", most: int = 150, overlap: int = OVERLAP, name: str = "chunks", endings: str = ENDINGS, pdf: bool = False) -> DataFrame:
    """df with the chunks of a text, as chunks() has them, from an Arrow function, which takes a fraction of the expression's time."""
    cut = Cut(most, overlap, endings, pdf)
    ship(df.sparkSession)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        out, count, rows = [], [], texts.to_pylist()
        for i in range(0, len(rows), 256):
            c = Chunks(rows[i : i + 256], cut)
            out.append(pa.array(c.texts(), pa.string()))
            count += c.count
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(count)], pa.int32()), pa.concat_arrays(out) if out else pa.array([], pa.string()))

    return df.withColumn(name, run.asNondeterministic()(F.col(text)))  # else the optimizer may compute it again in a filter


def each(array: Column | str) -> Column:
    """The array, to be exploded. For a bare column the optimizer would add a filter on its size and compute it twice."""
    return F.filter(array, lambda x: x.isNotNull())
