"""Repeated passages by suffix arrays over words.

The corpus is cut into shards of whole documents (at most SHARD words, or one longer document). In each, prefix doubling
after Larsson and Sadakane sorts the suffixes: words get ranks by hash, and every round sorts only the groups still tied,
by the rank of the suffix so many words on. Kasai's algorithm, run over many stretches of text in lockstep, gives common
prefixes up to `least` words. Neighbours with a common prefix that long form a class of equal passages; only the first of
each class goes on, the others are repeats.

Across shards, passages meet by content: each goes to the partition of its minimizer, the least hash of the SEED-word
runs in it, which equal passages share. There every shard's passages are a sorted run of fingerprints, and the runs are
merged pairwise by binary search; of equal ones the first in the order of documents wins. Partitions are sorted by minimizer,
and a task holds the passages of whole minimizers, about MERGE bytes of them at a time. Runs of words that many documents have
are minimizers only of passages that have no others, which are then copies of each other, so that different passages around
common words don't gather in one task. One document in SAMPLE, by hash, tells which those are; results don't depend on it.

Every passage of `least` words that also stands at an earlier place in the corpus is thus found, wherever that is. Passages
are taken as equal by 128 bits of hashes: the minimizer's 64 and a fingerprint's 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .shared import column, drop, fresh, keyed, parts, ship, table, with_key

U = np.uint64
LEAST, SEED, SHARD, MERGE = 50, 20, (1 << 20) - (1 << 14), 16 << 20
SAMPLE, COMMON, FEW = 64, 1024, 16  # common is what more than one in COMMON sampled documents have, and more than FEW
_RUN = "key long, shard long, doc long, th int, start int, n int, prints binary, kept long, kept_start int"


def _ordered(first: np.ndarray, second: np.ndarray | None, item: np.ndarray, bits: int) -> np.ndarray:
    """item, sorted by first, second, item: in one word if they fit."""
    if second is None and bits <= 31:
        return (np.sort((first.astype(U) << U(bits)) | item.astype(U)) & U((1 << bits) - 1)).astype(np.int64)
    if second is not None and 3 * bits <= 64:
        packed = np.sort((first.astype(U) << U(2 * bits)) | (second.astype(U) << U(bits)) | item.astype(U))
        return (packed & U((1 << bits) - 1)).astype(np.int64)
    return item[np.lexsort((item, first) if second is None else (item, second, first))]


def word_ranks(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A rank for each word by its hash; a word at a place in ends closes a document and has a rank of its own."""
    n, bits = len(hashes), max(1, int(len(hashes)).bit_length())
    packed = np.sort((hashes >> U(bits) << U(bits)) | np.arange(n, dtype=U)) if bits <= 24 else None
    order = (packed & U((1 << bits) - 1)).astype(np.int64) if packed is not None else np.argsort(hashes, kind="stable")
    h = hashes[order] >> U(bits) if packed is not None else hashes[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) if n else 0
    rank[ends] = n + np.arange(len(ends))
    return rank


def suffix_array(rank0: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes by their first `depth` words at least (ties by place), and each suffix's group: where it begins.

    rank0: ranks of the words; each document ends with one that occurs nowhere else.
    """
    n = len(rank0)
    bits = max(1, (2 * n).bit_length())
    place = np.arange(n)
    sa = _ordered(rank0, None, place, bits)
    group = np.empty(n, np.int64)

    def regroup(at, changes):
        """at: places in sa of the suffixes just sorted; changes: where a group begins. Returns the places still tied."""
        heads = np.maximum.accumulate(np.where(changes, at, 0))
        group[sa[at]] = heads
        alone = changes & np.append(changes[1:], True)
        return at[~alone]

    r = rank0[sa]
    tied = regroup(place, np.concatenate([[True], r[1:] != r[:-1]]) if n else np.zeros(0, bool))
    h = 1
    while len(tied) and h < depth:
        s = sa[tied]
        old, next_ = group[s], group[s + h]
        s = _ordered(old, next_, s, max(1, n.bit_length()))
        sa[tied] = s
        next_ = group[s + h]  # groups are rewritten only below, so these are still the last round's
        old = group[s]
        tied = regroup(tied, np.concatenate([[True], (old[1:] != old[:-1]) | (next_[1:] != next_[:-1])]))
        h *= 2
    return sa, group


def kasai(text: np.ndarray, sa: np.ndarray, group: np.ndarray, cap: int, stretch: int = 256) -> np.ndarray:
    """For each place in sa, the common prefix with the suffix before, up to cap words (at most the depth of sa).

    The text is cut into stretches; all of them advance together, each carrying the length over to the next suffix.
    Suffixes of one group, which are in order of place and not of text, share cap words; they carry nothing over.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    tied = np.zeros(n, bool)
    tied[sa[1:]] = group[sa[1:]] == group[sa[:-1]]
    lcp = np.zeros(n, np.int32)
    at = np.arange(0, n, stretch)
    stop = np.minimum(at + stretch, n)
    h = np.zeros(len(at), np.int64)
    at = at.copy()
    padded = np.concatenate([text, -1 - np.arange(cap + 1)])
    while len(at):
        j = before[at]
        t = tied[at]
        same = ~t & (j >= 0) & (h < cap) & (padded[at + h] == padded[j + h])
        h = np.where(same, h + 1, h)
        done = ~same
        lcp[at[done]] = np.where(t, cap, h)[done]
        at = at + done
        h = np.where(done, np.where(t, 0, np.maximum(h - 1, 0)), h)
        live = at < stop
        if not live.all():
            at, h, stop = at[live], h[live], stop[live]
    return lcp[sa]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class _Shard:
    """Documents gathered until there are enough; yields its runs."""

    def __init__(self, least: int, common: np.ndarray):
        self.least, self.common, self.docs, self.words = least, common, [], 0

    def add(self, key: int, th: int, hashes: np.ndarray):
        self.docs.append((key, th, hashes))
        self.words += len(hashes) + 1

    def runs(self) -> pa.RecordBatch | None:
        docs, least = sorted(self.docs, key=lambda d: d[:2]), self.least
        self.docs, self.words = [], 0
        docs = [d for i, d in enumerate(docs) if i == 0 or d[:2] != docs[i - 1][:2]]  # a repeated row is one document
        size = np.array([len(d[2]) for d in docs], np.int64)
        docs, size = [d for d in docs if len(d[2]) >= least], size[size >= least]
        if not docs:
            return None
        key, th = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int32)
        ends = np.cumsum(size + 1) - 1
        begins = ends - size
        text = np.empty(int(ends[-1]) + 1, U)
        for (_, _, h), b, e in zip(docs, begins, ends):
            text[b:e] = h
            text[e] = 0
        n = len(text)
        doc = np.repeat(np.arange(len(docs)), size + 1)
        ranks = word_ranks(text, ends)
        depth = 1 << (least - 1).bit_length()
        sa, group = suffix_array(ranks, depth)
        equal = kasai(ranks, sa, group, least) >= least
        heads = np.concatenate([[True], ~equal[1:]])
        number = np.cumsum(heads) - 1
        first = np.minimum.reduceat(sa, np.flatnonzero(heads))
        kept = np.empty(n, np.int64)
        kept[sa] = first[number]
        whole = np.arange(n) + least <= ends[doc]  # a passage that fits in its document
        repeat = whole & (kept != np.arange(n))
        shard = int(words.mix(np.array([key[0] ^ th[0], n, int(key[-1])], np.int64).view(U))[:1].view(np.int64)[0] ^ np.int64(key[-1]))
        out = []

        # repeats within the shard: stretches of them with the same shift
        at = np.flatnonzero(repeat)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) > 1) | (np.diff(kept[at]) != 1) | (doc[kept[at]][1:] != doc[kept[at]][:-1])
            a = at[new]
            count = np.diff(np.append(np.flatnonzero(new), len(at)))
            k = kept[a]
            out.append((None, a, count, None, k))

        # first passages: by minimizer, in stretches
        grams = words.ngram_hashes(text, SEED)
        bits = n.bit_length()
        small = (_order(grams, self.common) >> U(bits) << U(bits)) | np.arange(len(grams), dtype=U)
        least_at = (_sliding_least(small, least - SEED + 1) & U((1 << bits) - 1)).astype(np.int64)
        prints = words.mix(words.ngram_hashes(text, least)).astype("<u8")
        at = np.flatnonzero((whole & ~repeat)[: len(prints)])
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) > 1) | (np.diff(least_at[at]) != 0)
            starts = np.flatnonzero(new)
            a, count = at[starts], np.diff(np.append(starts, len(at)))
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32) * 8
            blob = pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(prints[at].tobytes())])
            out.append((grams[least_at[a]].view(np.int64), a, count, blob, None))
        batches = []
        for k, a, count, blob, keep in out:
            m, none = len(a), pa.nulls
            d = doc[a]
            batches.append(pa.RecordBatch.from_arrays([
                pa.array(k) if k is not None else pa.array(words.mix(key[d].view(U)).view(np.int64)), pa.array(np.full(m, shard)), pa.array(key[d]), pa.array(th[d]), pa.array((a - begins[d]).astype(np.int32)), pa.array(count.astype(np.int32)),
                blob if blob is not None else none(m, pa.binary()), pa.array(key[doc[keep]]) if keep is not None else none(m, pa.int64()), pa.array((keep - begins[doc[keep]]).astype(np.int32)) if keep is not None else none(m, pa.int32()),
            ], _RUN_NAMES))
        return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if batches else None


_RUN_NAMES = [c.split()[0] for c in _RUN.split(", ")]


def _order(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """By which the least is a minimizer: by 63 bits of hash, common ones (given by these) last."""
    out = words.mix(grams) >> U(1)
    if len(common):
        out[common[np.minimum(np.searchsorted(common, out), len(common) - 1)] == out] |= U(1 << 63)
    return out


def _grams(least: int):
    def run(batches):
        """Rows (gram): what _order() makes of each document's runs of SEED words, once; and a null for each document that has one."""
        for b in parts(batches):
            w, found = words.words_of(b.column(1)), []
            for d in range(b.num_rows):
                h = w.hash[w.splits[d] : w.splits[d + 1]]
                if len(h) >= least:
                    found.append(np.unique(_order(words.ngram_hashes(h, SEED), np.zeros(0, U))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.nulls(len(found), pa.int64())])], ["gram"])

    return run


def common_grams(docs: DataFrame, least: int) -> np.ndarray:
    """What _order() makes of the runs of SEED words that more than one in COMMON of the sampled documents have: so many times the
    words of a document at most, however many documents there are."""
    d = keyed(docs)
    some = d.filter(F.pmod(F.xxhash64(F.lit("grams"), "key", "th"), F.lit(SAMPLE)) == 0)
    counts = table(some.mapInArrow(_grams(least), "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("gram").isNull() | (F.col("n") > FEW)), "grams")
    all_ = counts.filter("gram is null").first()
    found = counts.filter(F.col("gram").isNotNull() & (F.col("n") * COMMON > (all_.n if all_ else 0))).select("gram").toArrow().column(0).to_numpy()
    drop(counts)
    return np.sort(found.astype(np.int64).view(U))


def _shards(least: int, common: np.ndarray = np.zeros(0, U)):
    def run(batches):
        shard = _Shard(least, common)
        for b in parts(batches):
            w = words.words_of(b.column(1))
            key, th = b.column(0).to_numpy(), b.column(2).to_numpy()
            for d in range(b.num_rows):
                h = w.hash[w.splits[d] : w.splits[d + 1]]
                if shard.words and shard.words + len(h) + 1 > SHARD:
                    if (out := shard.runs()) is not None:
                        yield out
                shard.add(int(key[d]), int(th[d]), h.copy())
        if (out := shard.runs()) is not None:
            yield out

    return run


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], winner: np.ndarray) -> None:
    """Runs of (sorted fingerprints, the places that have them). Merges pairs of runs by binary search; of two places
    with one fingerprint the lower wins, and winner[loser] is set to it."""
    while len(runs) > 1:
        merged = []
        for i in range(0, len(runs) - 1, 2):
            (ka, ia), (kb, ib) = sorted(runs[i : i + 2], key=lambda r: -len(r[0]))
            pos = np.searchsorted(ka, kb)
            same = ka[np.minimum(pos, len(ka) - 1)] == kb
            x, y = ia[pos[same]], ib[same]
            low, high = np.minimum(x, y), np.maximum(x, y)
            winner[high] = low
            ia = ia.copy()
            ia[pos[same]] = low
            rest = ~same
            merged.append((np.insert(ka, pos[rest], kb[rest]), np.insert(ia, pos[rest], ib[rest])))
        runs = merged + ([runs[-1]] if len(runs) % 2 else [])


def _merge(least: int):
    def run(batches):
        """Batches sorted by key: whole keys are gathered, up to MERGE bytes. Of a key with more, only first passages are kept on."""
        held, size, limit = [], 0, MERGE
        for b in batches:
            local = b.column(7).is_valid()
            if pc.any(local).as_py():
                yield _spans(b.filter(local))
                b = b.filter(pc.invert(local))
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size > limit:
                t, last, rest = pa.Table.from_batches(held), b.column(0)[b.num_rows - 1].as_py(), []
                if held[0].column(0)[0].as_py() == last:
                    yield from merged(t, rest)
                else:  # the last key may go on
                    cut = int(np.searchsorted(t.column("key").to_numpy(), last))
                    yield from merged(t.slice(0, cut))
                    rest = t.slice(cut).combine_chunks().to_batches()
                held, size = rest, sum(x.nbytes for x in rest)
                limit = max(MERGE, 2 * size)
        if held:
            yield from merged(pa.Table.from_batches(held))

    def merged(t: pa.Table, rest: list | None = None):
        """Batches of repeats among the rows; the first passages go to rest, if there is one."""
        key = t.column("key").to_numpy()
        low = np.sort(key)
        twice = np.unique(low[1:][low[1:] == low[:-1]])
        if not len(twice):
            if rest is not None:
                rest += t.to_batches()
            return
        shared = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
        t = t.filter(pa.array(shared)).sort_by([("doc", "ascending"), ("th", "ascending"), ("start", "ascending")]).combine_chunks()
        key, n = t.column("key").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        raw = t.column("prints").combine_chunks() if isinstance(t.column("prints"), pa.ChunkedArray) else t.column("prints")
        off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        prints = np.frombuffer(raw.buffers()[2], "<u8")[off[0] // 8 : off[-1] // 8]
        row = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        _, group = np.unique(key, return_inverse=True)
        full = np.unique(prints, return_inverse=True)[1].astype(np.int64) * int(group.max() + 1) + group[row]  # equal where key and fingerprint are
        _, shard = np.unique(t.column("shard").to_numpy(), return_inverse=True)
        shard = shard[row]
        order = np.lexsort((np.arange(len(row)), full, shard))
        runs, winner = [], np.arange(len(row))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0]))
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            at = order[a:b]
            k = full[at]
            once = np.concatenate([[True], k[1:] != k[:-1]])
            head = at[np.maximum.accumulate(np.where(once, np.arange(len(at)), 0))]
            winner[at] = head
            runs.append((k[once], at[once]))
        merge_runs(runs, winner)
        while True:
            further = winner[winner]
            if (further == winner).all():
                break
            winner = further
        at = np.flatnonzero(winner != np.arange(len(winner)))
        start, doc, th = t.column("start").to_numpy(), t.column("doc").to_numpy(), t.column("th").to_numpy()
        if rest is not None:
            i = np.flatnonzero(winner == np.arange(len(winner)))
            blob = pa.BinaryArray.from_buffers(pa.binary(), len(i), [None, pa.py_buffer((np.arange(len(i) + 1) * 8).astype(np.int32)), pa.py_buffer(prints[i].tobytes())])
            rest.append(pa.RecordBatch.from_arrays([pa.array(key[row[i]]), pa.array(np.zeros(len(i), np.int64)), pa.array(doc[row[i]]), pa.array(th[row[i]]), pa.array((start[row[i]] + shift[i]).astype(np.int32)), pa.array(np.ones(len(i), np.int32)), blob, pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int32())], _RUN_NAMES))
        if not len(at):
            return
        to = winner[at]
        s, k = start[row[at]] + shift[at], start[row[to]] + shift[to]
        d, h, kd = doc[row[at]], th[row[at]], doc[row[to]]
        other = (d != kd) | (s != k) | (h != th[row[to]])  # a row repeated in another shard is the same document
        if not other.any():
            return
        at, s, k, d, h, kd = (x[other] for x in (at, s, k, d, h, kd))
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(s) != 1) | (np.diff(k) != 1) | (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (kd[1:] != kd[:-1])
        a = np.flatnonzero(new)
        n = np.diff(np.append(a, len(at)))
        yield pa.RecordBatch.from_arrays([pa.array(d[a]), pa.array(h[a]), pa.array(s[a].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(kd[a]), pa.array(k[a].astype(np.int32))], _SPAN_NAMES)

    return run


_SPAN_NAMES = ["doc", "th", "start", "n", "kept", "kept_start"]


def _spans(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(i) for i in (2, 3, 4, 5, 7, 8)], _SPAN_NAMES)


def spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """key, th, kept, start, n, kept_start: longest stretches of n words from word `start` whose every passage of `least` words
    also stands, with the same shift, in document `kept`, earlier in the order of (doc_id, text hash, place)."""
    if least <= SEED:
        raise ValueError(f"least must exceed {SEED}")
    ship(docs.sparkSession)
    runs = keyed(docs).mapInArrow(_shards(least, common_grams(docs, least)), _RUN)
    found = runs.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_merge(least), "doc long, th int, start int, n int, kept long, kept_start int")
    w = Window.partitionBy("doc", "th", "kept", (F.col("start") - F.col("kept_start")).alias("shift")).orderBy("start")
    first = F.coalesce((F.col("start") > F.max(F.col("start") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    joined = found.withColumn("first", first).withColumn("island", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = joined.groupBy("doc", "th", "kept", (F.col("start") - F.col("kept_start")).alias("shift"), "island")
    out = g.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"), F.min("kept_start").alias("kept_start"))
    return out.select(F.col("doc").alias("key"), "th", "kept", "start", (F.col("stop") - F.col("start") + least - 1).cast("int").alias("n"), "kept_start")


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, kept_doc_id, start_word, n_words, kept_start_word: the stretches of a document that an earlier one, or the same
    document before, has too.

    Words are runs of letters, marks and digits in lower case. Nulls, empty texts and those of fewer than `least` words have
    no rows; very long texts count whole. Rows equal in doc_id and text are one document; a document without doc_id goes
    by a negative number from its text's hash. Ties go to the lower doc_id, then text hash, then place. An empty table
    gives no rows; columns other than doc_id and text don't matter.
    """
    return spans(docs, least).select(F.col("key").alias("doc_id"), F.col("kept").alias("kept_doc_id"), F.col("start").alias("start_word"), F.col("n").alias("n_words"), F.col("kept_start").alias("kept_start_word"))


def _cut(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    """The texts without those words, each with what follows it up to the next word; null if no word is left, and for a null."""
    out = []
    for b in parts([pa.RecordBatch.from_arrays([texts, starts, stops], ["text", "starts", "stops"])], 0):
        texts, starts, stops = b.columns
        w = words.words_of(texts)
        _, raw = words.buffers(texts)
        for d in range(b.num_rows):
            first, last = int(w.splits[d]), int(w.splits[d + 1])
            if first == last:
                out.append(None)
                continue
            gone = np.zeros(last - first + 1, np.int64)
            np.add.at(gone, np.minimum(starts[d].values.to_numpy(), last - first), 1)
            np.add.at(gone, np.minimum(stops[d].values.to_numpy(), last - first), -1)
            stay = np.cumsum(gone[:-1]) == 0
            if not stay.any():
                out.append(None)
                continue
            begin, end = int(w.offsets[d]), int(w.offsets[d + 1])
            from_ = np.append(w.start[first:last], end)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], stay.astype(np.int8), [0]])))
            pieces = [raw[begin : int(from_[0])]] + [raw[int(from_[a]) : int(from_[z])] for a, z in zip(edge[::2], edge[1::2])]
            out.append(b"".join(p.tobytes() for p in pieces).decode("utf8", "replace"))
    return pa.array(out, pa.string())


def cut_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without the words of repeated_passages(), with n_chars (where docs have it) counted anew; a document of which no
    word is left goes. Others stay as they are: nulls, empty and short texts, and every other column, whatever its name."""
    found = table(spans(docs, least), "repeats")
    each = found.groupBy("key", "th").agg(F.collect_list("start").alias("starts"), F.collect_list(F.col("start") + F.col("n")).alias("stops"))
    d, k, th = with_key(docs)
    starts, stops, new = fresh(d, "starts", "stops", "new_text")
    each = each.select(F.col("key").alias(k), F.col("th").alias(th), F.col("starts").alias(starts), F.col("stops").alias(stops))
    text = next(c for c in docs.columns if c.lower() == "text")
    cut = F.arrow_udf(_cut, "string").asNondeterministic()  # so that it runs once a row, and not again in the filter
    joined = d.join(each, [k, th], "left")
    some = F.col(starts).isNotNull()
    made = joined.withColumn(new, cut(F.when(some, column(joined, text).cast("string")), F.coalesce(F.col(starts), F.array().cast("array<int>")), F.coalesce(F.col(stops), F.array().cast("array<int>"))))
    made = made.filter(~some | F.col(new).isNotNull())
    put = {"text": F.col(new), "n_chars": F.length(new)}
    return made.select(*[(F.when(some, put[c.lower()].cast(docs.schema[c].dataType)).otherwise(column(made, c)) if c.lower() in put else column(made, c)).alias(c) for c in docs.columns])
