"""Packing documents into bins of `capacity` words by best-two-fit.

A document longer than a bin is cut into full bins and a rest. Within a shard of documents (by hash, about `shard_docs` each)
a bin is filled greedily with the longest piece that fits until none does. Then its shortest piece gives way to two
unpacked ones that together fit its place and the gap more tightly, if there are such; the piece waits for a later bin.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed, ship

CAPACITY, SHARD_DOCS = 2048, 1 << 15


class _Lengths:
    """The multiset of unpacked lengths, as sorted distinct lengths and their counts."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.count = np.bincount(lengths, minlength=capacity + 1)
        self.have = np.flatnonzero(self.count).tolist()

    def longest(self, most: int) -> int:
        k = bisect_right(self.have, most)
        return self.have[k - 1] if k else 0

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.have[bisect_right(self.have, n) - 1]

    def give(self, n: int) -> None:
        if not self.count[n]:
            self.have.insert(bisect_right(self.have, n), n)
        self.count[n] += 1

    def two(self, room: int, beyond: int) -> tuple[int, int] | None:
        """The two lengths of greatest sum in (beyond, room]; of equal sums, that with the longest piece."""
        x = np.array(self.have[: bisect_right(self.have, room - 1)], np.int64)
        if not len(x):
            return None
        k = np.searchsorted(x, room - x, side="right") - 1
        own = (k >= 0) & (x[np.maximum(k, 0)] == x) & (self.count[x] < 2)
        k = k - own
        total = np.where(k >= 0, x + x[np.maximum(k, 0)], 0)
        best = int(total.max())
        if best <= beyond:
            return None
        at = int(np.flatnonzero(total == best)[-1])
        return int(x[at]), int(x[k[at]])


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The lengths (1 to capacity) of the pieces in each bin."""
    left, bins = _Lengths(lengths, capacity), []
    while left.have:
        bin_, gap = [], capacity
        while n := left.longest(gap):
            left.take(n)
            bin_.append(n)
            gap -= n
        if gap:
            least = bin_[-1]  # greedy takes them in descending order
            pair = left.two(gap + least, least)
            if pair:
                bin_.pop()
                for n in pair:
                    left.take(n)
                left.give(least)
                bin_ += pair
        bins.append(bin_)
    return bins


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "ascending"), ("key", "ascending"), ("th", "ascending"), ("piece", "ascending")])
        n = t.column("n").to_numpy()
        ends = np.searchsorted(n, np.arange(capacity + 1), side="left")  # next piece of each length
        shard = int(t.column("shard")[0].as_py()) if len(n) else 0
        bins = best_two_fit(n, capacity)
        row, bin_, place = np.empty(len(n), np.int64), np.empty(len(n), np.int64), np.empty(len(n), np.int32)
        i = 0
        for b, pieces in enumerate(bins):
            for p, size in enumerate(pieces):
                row[i], bin_[i], place[i] = ends[size], b, p
                ends[size] += 1
                i += 1
        t = t.take(pa.array(row))
        return pa.table([t.column("key"), t.column("piece"), t.column("start"), t.column("n"), pa.array((shard << 32) + bin_), pa.array(place)], ["doc_id", "piece", "start_word", "n_words", "bin_id", "place"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, piece, start_word, n_words, bin_id, place: where each piece of each document goes.

    Words are runs of characters other than white space. Nulls and texts without a word have no rows; very long texts are cut into
    pieces of at most `capacity` words that together hold all of them. Repeated rows are each packed; a document without
    doc_id goes by a negative number from its text's hash. Equal lengths are taken by doc_id, text hash, piece. An empty table
    gives no rows; columns other than doc_id and text don't matter.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    ship(spark)
    shards = 1 + docs.count() // shard_docs
    d = keyed(docs)
    sized = d.select("key", "th", F.regexp_count("text", F.lit(r"[^\s]+")).alias("words"), F.pmod(F.xxhash64("key", "th"), F.lit(shards)).alias("shard")).filter("words > 0")
    last = ((F.col("words") - 1) / capacity).cast("int")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.select("key", "th", "shard", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).alias("n"))
    return pieces.groupBy("shard").applyInArrow(_pack(capacity), "doc_id long, piece int, start_word int, n_words int, bin_id long, place int")
