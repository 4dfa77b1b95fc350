"""Near duplicates by SimHash, all of them, found by blocks of the fingerprints.

A document's fingerprint has 128 bits: the signs of sums over its distinct words. Fingerprints up to `threshold` bits apart
(20) are near. Six blocks share those bits out, each with a radius, so that the radii and one more for each block come to
threshold + 1: fingerprints that are near differ by at most the radius in some block, or they would be over the threshold
apart. No pair is left to chance.

A block's highest bits are its place. A fingerprint lives at its own place in each block, and visits the lower places within
the radius. A task holds those that live at one place, in cells by the block's other bits; whoever lives there or visits looks
into the cells that its radius still reaches, and is compared in all 128 bits with those in them. Where fewer live than there
would be cells to look into, all are compared.

Documents linked by near fingerprints form a group, whose lowest doc_id stays. Equal fingerprints are one throughout; a place
gives no more links than it takes to connect those that it finds near, so that a large group of copies doesn't give all its
pairs. Nor are all of them compared: in a crowded cell, one that is near an earlier one follows it, and what is near a leader
needs no comparison with its followers; what is over twice the threshold from the leader can't be near them.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .shared import column, drop, fresh, keyed, parts, remove, scratch, ship, table, with_key

U = np.uint64
BITS, THRESHOLD = 15, 20
#: Bits of the blocks, wide ones first: theirs are the greater radii. A cell of over CROWD fingerprints chooses leaders.
WIDTHS, CROWD = (23, 23, 23, 20, 20, 19), 64
_SLICE = 1 << 16


def _syndromes() -> np.ndarray:
    """Of every word of 15 bits: the place (1 to 15) of the bit that, flipped, gives its codeword; 0 for a codeword."""
    x, s = np.arange(1 << BITS), np.zeros(1 << BITS, np.int64)
    for b in range(BITS):
        s ^= np.where(x >> b & 1, b + 1, 0)
    return s


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """home[x]: x's anchor. near[s]: masks that turn a word of syndrome s into each anchor within distance 2."""
    s = _syndromes()
    flip = np.concatenate([[0], 1 << np.arange(BITS)])
    home = np.arange(1 << BITS) ^ flip[s]
    masks = [0, *(1 << np.arange(BITS)), *(1 << a | 1 << b for a in range(BITS) for b in range(a))]
    near = [[m for m in masks if s[m] == k] for k in range(1 << 4)]  # syndromes are linear: mask and word cancel
    width = max(map(len, near))
    return home.astype(np.int32), np.array([n + [-1] * (width - len(n)) for n in near], np.int32)


#: The code's tables. The search of near pairs has no use for them: blocks of such words miss pairs over 15 bits apart.
HOME, NEAR = _tables()
SYNDROME = _syndromes().astype(np.int8)


def radii(threshold: int) -> list[int]:
    """Of each block; -1 where none of its pairs is needed. Each radius and one more come to threshold + 1."""
    each, more = divmod(threshold + 1, len(WIDTHS))
    return [min(w, each - 1 + (k < more)) for k, w in enumerate(WIDTHS)]


@lru_cache
def _masks(width: int, weight: int) -> np.ndarray:
    """All words of that width with that many ones."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), weight)], np.int32)


def _block(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprints' bits in block k."""
    at, width = sum(WIDTHS[:k]), WIDTHS[k]
    x = (b if at >= 64 else a) >> U(at % 64)
    if at < 64 < at + width:
        x = x | b << U(64 - at)
    return (x & U((1 << width) - 1)).astype(np.int32)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves for each text as an (n, 2) array, and the number of its distinct words."""
    w = words.words_of(texts)
    n = len(w.splits) - 1
    doc = words.document_of(w.splits).astype(U)
    distinct = np.sort(doc << U(44) | w.hash >> U(20))
    if len(distinct):
        distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
    doc = (distinct >> U(44)).astype(np.int64)
    counts = np.bincount(doc, minlength=n)
    sums = np.zeros((n, 128), np.int64)
    for a in range(0, len(distinct), _SLICE):
        part, d = distinct[a : a + _SLICE] & U((1 << 44) - 1), doc[a : a + _SLICE]
        both = np.stack([words.mix(part + U(0x51ED270B) * U(1 << 30)), words.mix(part ^ U(0x7F4A7C15F39CC060))], 1)
        bits = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        sums[d[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    signs = np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(signs).view(U).reshape(n, 2), counts


def _fingerprint_batches(batches):
    for whole in batches:
        for i in range(0, whole.num_rows, 1 << 18):  # fingerprints() numbers documents in 20 bits
            for b in parts([whole.slice(i, 1 << 18)]):
                f, n = fingerprints(b.column(1))
                out = pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64))], ["key", "th", "a", "b"])
                yield out.filter(pa.array(n > 0))


def _cover(threshold: int, top: int):
    def cover(batches):
        """Rows (place, flips, key, a, b): one at each block's own place, and one at each lower place within the radius, with the bits between."""
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                a, b = (batch.column(c).to_numpy().view(U) for c in (1, 2))
                row, place, flips = [], [], []
                for k, radius in enumerate(radii(threshold)):
                    own = _block(k, a, b) >> WIDTHS[k] - top
                    for e in range(min(radius, top) + 1):
                        to = own[:, None] ^ _masks(top, e)
                        r, c = np.nonzero(to <= own[:, None])
                        row.append(r), place.append(to[r, c] | k << top), flips.append(np.full(len(r), e, np.int8))
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(flips)), *(batch.column(c).take(row) for c in range(3))], ["place", "flips", "key", "a", "b"])

    return cover


def _runs(begin: np.ndarray, count: np.ndarray, most: int = 1 << 20):
    """Of runs of places: the run and the place of every one, a bounded number (or one run) at a time."""
    upto, k = np.cumsum(count), 0
    while k < len(count):
        e = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + most, side="right")))
        n = count[k:e]
        run = np.repeat(np.arange(k, e), n)
        yield run, begin[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        k = e


def _distances(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray):
    """The first place, and distances of some of (a, b) from all of (x, y), a bounded number at a time."""
    step = max(1, (1 << 19) // max(1, len(x)))
    for i in range(0, len(a), step):
        d = np.bitwise_count(a[i : i + step, None] ^ x[None, :])
        d += np.bitwise_count(b[i : i + step, None] ^ y[None, :])
        yield i, d


class _Anchor:
    """Fingerprints that are all compared: those at home, with whom all are compared as they come, and the links found.

    Without all_pairs, those at home that are near an earlier one follow it, as their leader; links connect the near ones.
    """

    def __init__(self, threshold: int, all_pairs: bool):
        self.threshold, self.all_pairs = threshold, all_pairs
        self.a, self.b, self.key = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        self.lead = np.zeros(0, np.int64)  # of each at home: its leader, or itself
        self.root = np.zeros(0, np.int64)  # and the first of those that it is linked to
        self.leaders = self.order = self.begin = self.count = None

    def add(self, home: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Rows in order, those at home first. Yields arrays of links (x, y)."""
        i, m = 0, int(home.sum())
        while i < m:  # first few, so that a large group soon has leaders
            j = min(m, i + min(4096, max(64, len(self.key))))
            n = len(self.key)
            lead = np.arange(n, n + j - i)
            for p, q in self._near(key[i:j], a[i:j], b[i:j]):
                if not self.all_pairs:
                    led = self.lead[p] == p
                    lead[q[led]] = np.minimum(lead[q[led]], p[led])  # any leader that is near does
                    yield from self._join(p, q + n, np.append(self.key, key[i:j]))
                else:
                    yield self._pairs(self.key[p], key[i:j][q])
            for k, d in _distances(a[i:j], b[i:j], a[i:j], b[i:j]):
                p, q = np.nonzero(d <= self.threshold)
                p, q = p[q > p + k] + k, q[q > p + k]
                if self.all_pairs:
                    yield self._pairs(key[i:j][p], key[i:j][q])
                else:
                    yield from self._join(p + n, q + n, np.append(self.key, key[i:j]))
            self.a, self.b, self.key = np.append(self.a, a[i:j]), np.append(self.b, b[i:j]), np.append(self.key, key[i:j])
            self.lead, self.root, self.leaders = np.append(self.lead, lead), np.append(self.root, np.arange(len(self.root), len(self.key))), None
            i = j
        for p, q in self._near(key[m:], a[m:], b[m:]):
            yield from self._tie(p, key[m:][q])

    def _tie(self, p: np.ndarray, key: np.ndarray):
        """Links of those at home with visitors: a visitor links all that it is near to."""
        if self.all_pairs:
            yield self._pairs(self.key[p], key)
            return
        order = np.lexsort((p, key))
        p, key = p[order], key[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        yield self.key[p[first]], key[first]
        yield from self._join(p[~first], p[at][~first], self.key)

    @staticmethod
    def _pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(x, y), np.maximum(x, y)

    def _near(self, key: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Places (at home, in the rows) of near ones, of others than themselves; for a row near a leader, its followers are left out."""
        if not len(key) or not len(self.key):
            return
        self._index()
        for i, d in _distances(self.a[self.leaders], self.b[self.leaders], a, b):
            p, q = np.nonzero(d <= self.threshold)
            p = self.leaders[p + i]
            other = self.key[p] != key[q]
            if other.any():
                yield p[other], q[other]
            led = np.flatnonzero(self.count[i : i + len(d)])
            if not len(led):
                continue
            p, q = np.nonzero((d[led] > self.threshold) & (d[led] <= 2 * self.threshold))
            p = led[p] + i
            yield from self._followers(p, q, key, a, b)

    def _followers(self, p: np.ndarray, q: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Places (at home, in the rows) of near ones among the followers of leaders p (numbered among leaders), for rows q."""
        for run, x in _runs(self.begin[p], self.count[p]):
            x, y = self.order[x], q[run]
            ok = (np.bitwise_count(self.a[x] ^ a[y]) + np.bitwise_count(self.b[x] ^ b[y]) <= self.threshold) & (self.key[x] != key[y])
            if ok.any():
                yield x[ok], y[ok]

    def _index(self):
        """Leaders, and their followers in one order with where each leader's begin."""
        if self.leaders is None:
            self.leaders = np.flatnonzero(self.lead == np.arange(len(self.lead)))
            self.order = np.argsort(self.lead, kind="stable")
            self.order = self.order[self.lead[self.order] != self.order]
            follows = np.searchsorted(self.leaders, self.lead[self.order])
            self.count = np.bincount(follows, minlength=len(self.leaders))
            self.begin = np.cumsum(self.count) - self.count

    def _join(self, p: np.ndarray, q: np.ndarray, key: np.ndarray):
        """Links of those at home, of the given keys, that weren't linked yet."""
        if len(key) > len(self.root):
            self.root = np.append(self.root, np.arange(len(self.root), len(key)))
        while True:
            x, y = self.root[p], self.root[q]
            apart = x != y
            if not apart.any():
                return
            p, q = p[apart], q[apart]
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            high, once = np.unique(high, return_index=True)
            low = low[once]
            yield key[low], key[high]
            self.root[high] = low
            while True:
                further = self.root[self.root]
                if (further == self.root).all():
                    break
                self.root = further


class _Cells(_Anchor):
    """A place of block k: those at home in cells by the block's lower bits, of which a row looks into those within its radius.

    Rows come in order, those at home (flips 0) first; end() is called after the last. Up to `few` at home, all are compared.
    """

    def __init__(self, threshold: int, all_pairs: bool, k: int, top: int, few: int | None = None):
        super().__init__(threshold, all_pairs)
        self.k, self.low, self.radius = k, WIDTHS[k] - top, radii(threshold)[k]
        self.masks = [_masks(self.low, w) for w in range(min(self.radius, self.low) + 1)]
        self.few = sum(map(len, self.masks)) if few is None else few
        self.waiting, self.held, self.size, self.first = [], [], 0, None

    def add(self, flips: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray):
        m = int((flips == 0).sum())
        if m:
            self.waiting.append((key[:m], a[:m], b[:m]))
        if m == len(key):
            return
        yield from self._settle()
        flips, key, a, b = flips[m:], key[m:], a[m:], b[m:]
        if self.first is None:
            yield from super().add(np.zeros(len(key), bool), key, a, b)
            return
        for e in np.unique(flips):
            at = np.flatnonzero(flips == e)
            for p, q in self._look(key[at], a[at], b[at], int(e)):
                self.held.append((p, key[at][q]))
                self.size += len(p)
        if self.size > max(1 << 16, len(self.key)):
            yield from self._tie_held()

    def end(self):
        yield from self._settle()
        yield from self._tie_held()

    def _tie_held(self):
        if self.held:
            p, key = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.size = [], 0
            yield from self._tie(p, key)

    def _settle(self):
        """All at home have come: cells are made, crowded ones choose leaders, and those at home look into their own and lower cells."""
        if not self.waiting:
            return
        key, a, b = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting = []
        if len(key) <= self.few:
            yield from super().add(np.ones(len(key), bool), key, a, b)
            return
        cell = self._cell(a, b)
        order = np.argsort(cell, kind="stable")
        cell, self.key, self.a, self.b = cell[order], key[order], a[order], b[order]
        n = len(cell)
        self.lead, self.root = np.arange(n), np.arange(n)
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        ends = np.append(heads[1:], n)
        crowded = ends - heads > CROWD
        for s, e in zip(heads[crowded].tolist(), ends[crowded].tolist()):
            crowd = _Anchor(self.threshold, self.all_pairs)
            yield from crowd.add(np.ones(e - s, bool), self.key[s:e], self.a[s:e], self.b[s:e])
            self.lead[s:e], self.root[s:e] = s + crowd.lead, s + crowd.root
        self._index()
        self.first = np.searchsorted(cell[self.leaders], np.arange((1 << self.low) + 1)).astype(np.int32)
        self.some = self.first[1:] > self.first[:-1]
        self.la, self.lb = self.a[self.leaders], self.b[self.leaders]
        done = np.zeros(1 << self.low, bool)
        done[cell[heads[crowded]]] = True
        found, size = [], 0
        for i in range(0, n, 4096):
            s = slice(i, i + 4096)
            for p, q in self._look(self.key[s], self.a[s], self.b[s], 0, i, done):
                found.append((p, q + i))
                size += len(p)
            if found and (size > max(1 << 16, n) or i + 4096 >= n):
                p, q = (np.concatenate(x) for x in zip(*found))
                found, size = [], 0
                if self.all_pairs:
                    yield self._pairs(self.key[p], self.key[q])
                else:
                    yield from self._join(p, q, self.key)

    def _cell(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _block(self.k, a, b) & (1 << self.low) - 1

    def _look(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, flips: int, at: int | None = None, done: np.ndarray | None = None):
        """Places (at home, in the rows) of near ones, in the cells within what flips leave of the radius; for a row near a leader,
        its followers are left out. Of rows that are those at home from `at` on, only with earlier ones, and not within cells that are done."""
        cell = self._cell(a, b)
        most = 2 * self.threshold if len(self.order) else self.threshold
        masks = np.concatenate(self.masks[: self.radius - flips + 1])
        step = max(1, (1 << 19) // len(cell))
        for i in range(0, len(masks), step):
            to = cell[:, None] ^ masks[i : i + step]
            there = self.some[to]
            if at is not None:
                there &= to <= cell[:, None]
                if i == 0:  # the first mask is none
                    there[:, 0] &= ~done[cell]
            r, c = np.nonzero(there)
            to = to[r, c]
            for run, x in _runs(self.first[to], self.first[to + 1] - self.first[to]):
                q = r[run]
                if at is not None:
                    earlier = self.leaders[x] < q + at
                    x, q = x[earlier], q[earlier]
                d = np.bitwise_count(self.la[x] ^ a[q])
                half = np.flatnonzero(d <= most)
                x, q = x[half], q[half]
                d = d[half] + np.bitwise_count(self.lb[x] ^ b[q])
                near = d <= self.threshold
                p, y = self.leaders[x[near]], q[near]
                other = self.key[p] != key[y]
                if other.any():
                    yield p[other], y[other]
                if len(self.order):
                    far = ~near & (d <= most) & (self.count[x] > 0)
                    yield from self._followers(x[far], q[far], key, a, b)


def _compare(threshold: int, all_pairs: bool, top: int):
    def compare(batches):
        """A partition holds its places' rows, sorted by place, those at home first: each against all that it looks at."""
        now, at, found, size = None, None, [], 0
        for b in batches:
            place, flips, key, x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else []
            for s, e in zip(heads, np.append(heads[1:], len(place))):
                if place[s] != at:
                    for links in now.end() if now else ():
                        found.append(links)
                        size += len(links[0])
                    at, now = place[s], _Cells(threshold, all_pairs, int(place[s]) >> top, top)
                for i in range(int(s), int(e), 4096):
                    j = min(int(e), i + 4096)
                    for links in now.add(flips[i:j], key[i:j], x[i:j].view(U), y[i:j].view(U)):
                        found.append(links)
                        size += len(links[0])
                if size > 1 << 18:
                    yield _links(found)
                    found, size = [], 0
        found += now.end() if now else []
        if found:
            yield _links(found)

    return compare


def _links(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (np.concatenate(z) for z in zip(*found))
    x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])


def near_pairs(prints: DataFrame, threshold: int = THRESHOLD, all_pairs: bool = True) -> DataFrame:
    """x < y: keys of fingerprints (key, a, b) at most threshold bits apart; or, of those, links enough to connect the same ones."""
    n = prints.count()
    top = min(12, max(4, (n >> 21).bit_length()))  # up to some 2 million live at a place
    tasks = min(len(WIDTHS) << top, 1 + (n >> 11))
    cover = prints.select("key", "a", "b").mapInArrow(_cover(threshold, top), "place int, flips byte, key long, a long, b long")
    sorted_ = cover.repartition(tasks, "place").sortWithinPartitions("place", "flips")
    return sorted_.mapInArrow(_compare(threshold, all_pairs, top), "x long, y long").distinct()


def components(spark, pairs: DataFrame) -> DataFrame:
    """node, root: the lowest node that each node of the pairs (x, y) is linked to. Rounds of least neighbour and
    pointer jumping, each written to the shared folder."""
    links = table(pairs.select("x", "y").union(pairs.select(F.col("y"), F.col("x"))), "links")
    at = table(links.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        uri = scratch(spark, "roots")
        lower = links.join(at.withColumnRenamed("node", "y"), "y").select(F.col("x").alias("node"), "root")
        least = at.union(lower).groupBy("node").agg(F.min("root").alias("root"))
        jumped = least.join(at.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.least("root", "next").alias("root"))
        new = table(jumped, "roots", uri)
        changed = new.join(at.withColumnRenamed("root", "was"), "node").filter("root <> was").limit(1).count()
        drop(at)
        at = new
        if not changed:
            drop(links)
            return at


def prints_of(docs: DataFrame) -> DataFrame:
    """key, th, a, b: the fingerprint of every row with a word, and what keyed() knows the row by."""
    ship(docs.sparkSession)
    return keyed(docs).mapInArrow(_fingerprint_batches, "key long, th int, a long, b long")


def groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """key, th, kept (key, th): each row with a word, and the least row of its group by doc_id and text hash."""
    spark = docs.sparkSession
    prints = table(prints_of(docs), "prints")
    reps = table(prints.groupBy("a", "b").agg(F.min(F.struct("key", "th")).alias("least")).withColumn("node", F.monotonically_increasing_id()), "reps")
    links = table(near_pairs(reps.withColumnRenamed("node", "key").select("key", "a", "b"), threshold, False), "pairs")
    roots = components(spark, links)
    drop(links)
    linked = reps.join(roots, "node")
    least = linked.groupBy("root").agg(F.min("least").alias("kept"))
    far = linked.join(least, "root").select("node", "kept")
    of = table(reps.join(far, "node", "left").select("a", "b", F.coalesce("kept", "least").alias("kept")), "classes")
    drop(roots, reps)
    return prints.join(of, ["a", "b"]).select("key", "th", "kept")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, kept_doc_id: each document that goes, and the lowest doc_id of its group, which stays.

    Nulls, empty texts and texts without a word are in no group. A document without doc_id goes by a negative number from
    its text's hash. Equal texts always share a group; of rows of one doc_id in a group only those of the other doc_ids are
    told here. Very long texts are read whole. An empty table gives no rows; columns other than doc_id and text don't matter.
    """
    return groups(docs, threshold).select(F.col("key").alias("doc_id"), F.col("kept.key").alias("kept_doc_id")).filter("doc_id <> kept_doc_id").distinct()


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs without the rows that are near another of a lower doc_id (of one doc_id, of a lower text hash) in their group; of rows
    equal in doc_id and text one stays, the first by all columns that have an order.

    A doc_id with two texts that aren't near keeps both. Rows without a word stay as they are (equal ones once); the columns are
    those of docs, whatever their names.
    """
    d, k, th = with_key(docs)
    gone = groups(docs, threshold).filter("key <> kept.key or th <> kept.th").select("key", "th").distinct().withColumn("gone", F.lit(True))
    known = keyed(docs).groupBy("key", "th").agg(F.count("*").alias("n")).filter("n > 1").select("key", "th")
    gone = table(gone, "gone")
    twice = table(known.join(gone, ["key", "th"], "left_anti"), "twice")
    named = lambda t: t.select(F.col("key").alias(k), F.col("th").alias(th))
    once = d.join(named(gone.select("key", "th").union(twice)), [k, th], "left_anti")
    (n,) = fresh(d, "place")
    w = Window.partitionBy(k, th).orderBy(*[column(d, f.name) for f in docs.schema.fields if not _unordered(f.dataType)], F.lit(1))
    first = d.join(named(twice), [k, th], "left_semi").withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1)
    return once.drop(k, th).unionByName(first.drop(k, th, n))


def _unordered(kind) -> bool:
    return any(x in kind.simpleString() for x in ("map<", "variant", "interval", "void"))
