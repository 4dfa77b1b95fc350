"""Benchmark decontamination by spaced-seed hashing.

A mask names the word positions of a window that count; the others may hold any word. Every window of the training
documents and of the benchmark items is hashed under each mask, and equal hashes join them. Around a hit, item and document
are compared word by word on the hit's diagonal: an overlap is the stretch of greatest score (a match 1, a substitution
-PENALTY), and counts if it has LEAST matching words, or all of a shorter item's. No such overlap is left to chance: from
any of its places to its end the score is positive, so its last LEAST matches have at most three substitutions among them,
in one of 91 orders, and one of the masks fits within the matches of each (a lesser `least` has more orders, of which some
are missed). An item of which ALIKE of all words match on the diagonal counts as well, from its first match to its last; at
least CERTAIN words have to, as many as a mask holds. Such copies are all found, at any length: of an item's pieces of PIECE
words, one more than there may be substitutions are sought, so that one of them is whole. Items of fewer than SHORTEST words
are no passage that could be told from ordinary text: they are not sought, and unusable() lists them.

Of consecutive hits on one diagonal only the first is taken, so that repetitive texts (number grids, tables) give as many
diagonals as they have places and not their product; and of a document's and an item's diagonals, those after a whole copy
aren't compared.

The benchmark's hashes go to every task in slices of at most `slice_words` words (or one longer item); a larger benchmark takes
several scans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import column, keyed, parts, ship, table, with_key

U = np.uint64
#: Made for LEAST and PENALTY: a lesser one of either needs other masks.
MASKS = ("10011101111", "11010011111", "101001101111", "11000101011011")
LEAST, PENALTY = 12, 3
ALIKE, CERTAIN, PIECE, SHORTEST = 0.75, 8, 3, 3
_PIECES = -1  # where the pieces stand among the masks
_MOST = 1 << 18
_CELLS = 1 << 22
_ODD = (np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 62, 64, dtype=np.uint64) << U(1)) | U(1)


def spaced_hashes(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """A hash of the masked words of each window of h."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(salt) * _ODD[63])
    for k, p in enumerate(i for i, c in enumerate(mask) if c == "1"):
        out += h[p : p + n] * _ODD[k]
    return out ^ (out >> U(29))


class Index:
    """The items' words, and where each masked hash occurs in them."""

    def __init__(self, items: list[tuple[int, str]], shortest: int = SHORTEST):
        w = words.words_of(pa.array([t for _, t in items], pa.large_string()))
        self.ids, self.splits, self.words = [i for i, _ in items], w.splits, w.hash
        size = np.diff(w.splits)
        usable = size >= shortest
        found = []
        for m, mask in enumerate(MASKS):
            found.append((m, 1, *self._windows(mask, m, usable)))
        longest = min(map(len, MASKS))
        self.short = sorted({int(n) for n in size if shortest <= n < longest})
        for n in self.short:  # an item shorter than every mask is sought whole
            found.append((len(MASKS) + n, n, *self._windows("1" * n, len(MASKS) + n, size == n)))
        self.need = np.maximum(np.ceil(ALIKE * size), np.minimum(size, CERTAIN)).astype(np.int64)
        spare = np.where(usable, size - self.need, 0)
        h, at = self._windows("1" * PIECE, len(MASKS) + PIECE, spare > 0)
        self.doc = words.document_of(w.splits)
        piece, rest = np.divmod(at - w.splits[self.doc[at]], PIECE)
        sought = (rest == 0) & (piece <= spare[self.doc[at]])
        found.append((_PIECES, PIECE, h[sought], at[sought]))
        self.hashes = {}
        for m, step, h, at in found:
            order = np.argsort(h, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[h >> U(44)] = True
            before = np.zeros(len(self.words) + 1, U)  # the hash of the window `step` words before, 0 for none
            before[at] = h
            before = np.where(at - w.splits[self.doc[at]] >= step, before[np.maximum(at - step, -1)], U(0))
            self.hashes[m] = (h[order], at[order], before[order], sieve, step)

    def _windows(self, mask, salt, only=None):
        h = spaced_hashes(self.words, mask, salt)
        doc = words.document_of(self.splits)
        at = np.arange(len(h))
        ok = doc[at] == doc[at + len(mask) - 1] if len(h) else np.zeros(0, bool)
        if only is not None:
            ok &= only[doc[at]]
        return words.mix(h[ok]), at[ok]

    def _meets(self, w: words.Words, m: int):
        """Places in the batch's words and the items', a bounded number at once, where windows have the same hash and those
        one step before them have not."""
        known, at, before, sieve, step = self.hashes[m]
        size = len(MASKS[m]) if 0 <= m < len(MASKS) else PIECE if m == _PIECES else m - len(MASKS)
        mask = MASKS[m] if 0 <= m < len(MASKS) else "1" * size
        if not len(known) or len(w.hash) < size:
            return
        h = words.mix(spaced_hashes(w.hash, mask, len(MASKS) + PIECE if m == _PIECES else m))
        some = np.flatnonzero(sieve[h >> U(44)])
        some = some[known[np.minimum(np.searchsorted(known, h[some]), len(known) - 1)] == h[some]]
        doc = words.document_of(w.splits)
        some = some[doc[some] == doc[some + size - 1]]
        if not len(some):
            return
        had = (some >= step) & (doc[np.maximum(some - step, 0)] == doc[some])
        last = np.where(had, h[np.maximum(some - step, 0)], U(0))
        hashes, number = np.unique(h[some], return_inverse=True)
        lasts, which = np.unique(last, return_inverse=True)
        order = np.lexsort((some, which, number))
        some, both = some[order], (number.astype(np.int64) * (len(lasts) + 1) + which)[order]
        # each of the items' places with such a hash, against the documents' places with another window before
        a, b = np.searchsorted(known, hashes), np.searchsorted(known, hashes, side="right")
        n = b - a
        place = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        number = np.repeat(np.arange(len(hashes)), n)
        same = np.minimum(np.searchsorted(lasts, before[place]), len(lasts) - 1)
        same = np.where((lasts[same] == before[place]) & (before[place] != 0), same, len(lasts))
        low, high = np.searchsorted(both, number * (len(lasts) + 1)), np.searchsorted(both, (number + 1) * (len(lasts) + 1))
        out, back = np.searchsorted(both, number * (len(lasts) + 1) + same), np.searchsorted(both, number * (len(lasts) + 1) + same, side="right")
        first, count = np.concatenate([low, back]), np.concatenate([out - low, high - back])
        place = np.concatenate([place, place])
        while len(place):  # a bounded number at once; a long row of them in pieces
            upto = np.cumsum(np.minimum(count, _MOST))
            k = max(1, int(np.searchsorted(upto, _MOST, side="right")))
            now = np.minimum(count[:k], _MOST)
            p = some[np.repeat(first[:k], now) + np.arange(now.sum()) - np.repeat(np.cumsum(now) - now, now)]
            yield p, at[np.repeat(place[:k], now)]
            first[:k] += now
            count[:k] -= now
            left = count > 0
            if left.all() and not now.any():
                return
            first, count, place = first[left], count[left], place[left]

    def _alike(self, w: words.Words, rows: np.ndarray) -> np.ndarray:
        """Those rows of hits() whose diagonal has the matches that the item needs."""
        if not len(w.hash):
            return rows[:0]
        live, missed, k = np.arange(len(rows)), np.zeros(len(rows), np.int64), 0
        size, kept = np.diff(self.splits), []
        doc, item, base = rows.T
        while len(live):
            at = base[live] + k
            inside = (at >= w.splits[doc[live]]) & (at < w.splits[doc[live] + 1])
            missed += ~(inside & (w.hash[np.clip(at, 0, len(w.hash) - 1)] == self.words[self.splits[item[live]] + k]))
            k += 1
            ok = missed <= (size - self.need)[item[live]]
            done = ok & (size[item[live]] == k)
            kept.append(live[done])
            live, missed = live[ok & ~done], missed[ok & ~done]
        return rows[np.concatenate(kept)] if kept else rows

    def hits(self, w: words.Words) -> np.ndarray:
        """Rows (document, item, item's first word's place among the batch's words), each once."""
        doc, found = words.document_of(w.splits), []
        for m in self.hashes:
            for p, q in self._meets(w, m):
                item = self.doc[q]
                rows = np.stack([doc[p], item, p - (q - self.splits[item])], 1)
                found.append(self._alike(w, rows) if m == _PIECES else rows)
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def overlaps(self, w: words.Words, least: int) -> dict[tuple[int, int], tuple[int, int, int]]:
        """For each document and item: first word in the document, words and matches of the best overlap that has matches
        enough; of equal ones the first. On a diagonal, that is all of it or its best stretch."""
        rows, best, i = self.hits(w), {}, 0
        size = np.diff(self.splits)
        pair = np.cumsum(np.concatenate([[0], (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
        whole = np.zeros(len(rows), bool)  # pairs with a whole copy: no later diagonal is better
        while i < len(rows):
            upto = np.cumsum(size[rows[i : i + _CELLS, 1]])
            j = i + max(1, int(np.searchsorted(upto, _CELLS // 16, side="right")))
            at = np.arange(i, j)[~whole[pair[i:j]]]
            i = j
            for n in np.unique(size[rows[at, 1]]).tolist():  # items of one length together
                some = at[size[rows[at, 1]] == n]
                if not len(some):
                    continue
                doc, item, base = rows[some].T
                where = base[:, None] + np.arange(n)
                inside = (where >= w.splits[doc][:, None]) & (where < w.splits[doc + 1][:, None])
                same = inside & (w.hash[np.clip(where, 0, len(w.hash) - 1)] == self.words[self.splits[item][:, None] + np.arange(n)])
                total = same.sum(axis=1)
                upto_ = np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(np.where(same, 1, np.where(inside, -PENALTY, -n * PENALTY - 1)), axis=1)], 1)
                e = (upto_ - np.minimum.accumulate(upto_, axis=1)).argmax(axis=1)
                s = np.where(np.arange(n + 1) <= e[:, None], upto_, upto_.max() + 1).argmin(axis=1)
                s = np.where(e > 0, s, 0)
                matches = np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(same, axis=1)], 1)
                r = np.arange(len(some))
                stretch = matches[r, e] - matches[r, s]
                enough = total >= self.need[item]
                s = np.where(enough, same.argmax(axis=1), s)
                e = np.where(enough, n - same[:, ::-1].argmax(axis=1), e)
                got = np.where(enough, total, stretch)
                for k in np.flatnonzero(enough | (stretch >= min(least, n))).tolist():
                    o = (int(base[k] - w.splits[doc[k]] + s[k]), int(e[k] - s[k]), int(got[k]))
                    key = int(doc[k]), int(item[k])
                    if key not in best or (o[2], -o[0]) > (best[key][2], -best[key][0]):
                        best[key] = o
                whole[pair[some[got == n]]] = True
        return best


def _search(index: Index, least: int):
    def run(batches):
        for b in parts(batches):
            best = index.overlaps(words.words_of(b.column(1)), least)
            if best:
                rows = pa.array([d for d, _ in best])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array([index.ids[i] for _, i in best], pa.int64()), *(pa.array([o[k] for o in best.values()], pa.int32()) for k in range(3))], ["key", "th", "item", "start", "n", "matched"])

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    text = column(benchmark, "text").cast("string")
    d = benchmark.select(column(benchmark, "item_id").cast("long").alias("item"), text.alias("text")).filter("text is not null").distinct()
    return d.withColumn("n", F.regexp_count("text", F.lit(r"[\p{L}\p{M}\p{N}]+")))


def unusable(benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """item_id, text, n_words of the benchmark's items of fewer than `shortest` words, which aren't sought. Null texts have no row,
    repeated rows have one; other columns don't matter."""
    return _items(benchmark).filter(F.col("n") < shortest).select(F.col("item").alias("item_id"), "text", F.col("n").alias("n_words"))


def _slices(items: DataFrame, slice_words: int):
    """The items in order, as lists of at most so many words (or one longer item)."""
    held, n = [], 0
    for r in items.orderBy("item", "text").toLocalIterator():
        if held and n + r.n > slice_words:
            yield held
            held, n = [], 0
        held.append((r.item, r.text))
        n += r.n
    yield held


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, slice_words: int = 2_000_000, shortest: int = SHORTEST) -> DataFrame:
    """key, th, item, start, n, matched: the best overlap of each document and item that have one."""
    spark = docs.sparkSession
    ship(spark)
    d, out, last = keyed(docs), None, None
    for items in _slices(_items(benchmark).filter(F.col("n") >= shortest), slice_words):
        if last is not None:  # another follows: this one's scan is done at once, so that the driver holds one index
            out = table(last, "overlaps") if out is None else out.unionByName(table(last, "overlaps"))
        last = d.mapInArrow(_search(Index(items, shortest), least), "key long, th int, item long, start int, n int, matched int")
    return last if out is None else out.unionByName(last)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, start_word, n_words, n_matched: the best overlap of each document and benchmark item that have one.

    Words are runs of letters, marks and digits in lower case. Nulls, empty texts and items have no rows; very long texts count
    whole; an empty table on either side gives none. Of equal overlaps the first counts. A row repeated in docs gives its rows
    again; a document without doc_id goes by a negative number from its text's hash, an item without item_id has a null.
    Items of fewer than `shortest` words are left out (unusable() lists them). Columns other than doc_id, item_id and text
    don't matter.
    """
    return overlaps(docs, benchmark, least, shortest=shortest).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").alias("start_word"), F.col("n").alias("n_words"), F.col("matched").alias("n_matched"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """docs without the documents that contaminated() has rows for; nulls, empty and repeated rows stay as they are, and so do all columns."""
    found = table(overlaps(docs, benchmark, least, shortest=shortest).select("key", "th").distinct(), "leaks")
    d, k, th = with_key(docs)
    return d.join(found.select(F.col("key").alias(k), F.col("th").alias(th)), [k, th], "left_anti").drop(k, th)
