"""Chunk scores by PageRank over word or chunk graphs.

A document's graph is small and its ranking iterative, so documents are ranked in an Arrow function that receives tokens and
returns scores; texts stay in the JVM, and nothing is exchanged between tasks. A batch of documents is one graph of as many
parts: pairs, weights, ranks and scores of all of them are computed at once, over arrays of numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cutting import numbered
from ..scratch import drop, table

_MOST = 1 << 18  # tokens of documents that are ranked at once (or one longer document), and pairs that are summed at once


def pageranks(
    graph: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, many: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the nodes of undirected weighted graphs, by power iteration, and whether each graph's converged.

    graph: the graph (from 0) of each node. A graph of n nodes is done when its ranks change by less than n * tolerance in all; one
    that isn't after so many rounds has ranks of 0. many: how many alike nodes each stands for, which have the same edges and so the
    same rank; an edge from a to a is one between any two of these.
    """
    n = len(graph)
    many = np.ones(n) if many is None else many
    graphs = int(graph.max()) + 1 if n else 0
    size = np.bincount(graph, many, graphs)
    other = a != b
    src, dst, w = np.concatenate([a, b[other]]), np.concatenate([b, a[other]]), np.concatenate([weight, weight[other]])
    out = np.bincount(src, w * (many[dst] - (src == dst)), n)
    share = w * (many[src] - (src == dst)) / np.where(out[src] > 0, out[src], 1)
    idle = out == 0
    each = size[graph] if n else np.zeros(0, np.int64)
    ranks, done = np.zeros(n), np.zeros(graphs, bool)
    live, x = np.arange(n), 1 / np.maximum(each, 1)
    for _ in range(rounds):
        if not len(live):
            break
        of = graph[live]
        lost = np.bincount(of, np.where(idle[live], x * many[live], 0), graphs)[of]
        new = damping * (np.bincount(dst, x[src] * share, len(live)) + lost / each[live]) + (1 - damping) / each[live]
        close = (np.bincount(of, np.abs(new - x) * many[live], graphs) < size * tolerance) & ~done
        ranks[live[close[of]]] = new[close[of]]
        done |= close
        x = new
        if 2 * done[of].sum() > len(of):  # go on with the others alone
            stay = ~done[of]
            number = np.cumsum(stay) - 1
            edge = stay[src]
            src, dst, share = number[src[edge]], number[dst[edge]], share[edge]
            live, x = live[stay], x[stay]
    return ranks, done


def pagerank(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Ranks of one graph of n nodes; zeros if they don't converge."""
    return pageranks(np.zeros(n, np.int64), a, b, weight, damping, rounds, tolerance)[0]


@dataclass(frozen=True)
class Ranker:
    """What graph is built, and how ranks become scores.

    Kinds: "textrank" sums 1/distance over the occurrences of two tokens; "singlerank", "positionrank" and "combined" weigh these
    by tokens' TF-IDF or places; "topicrank" is a graph of chunks; "semantic" one of words by the likeness of their counts over
    chunks: the cosine, or what `similarity` makes of a document's words x chunks matrix of counts (a words x words matrix).
    smooth and sublinear are those of TF-IDF: whether a document of all words is added, whether 1 + ln(count) is taken.
    """

    kind: str = "textrank"
    window: int = 3
    damping: float = 0.85
    least: float = 0.1
    tfidf: bool = True
    position: bool = True
    decay: float = 0.95
    similarity: Callable[[np.ndarray], np.ndarray] | None = None
    smooth: bool = True
    sublinear: bool = False


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many: each member's group, and its place in it."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


class _Pairs:
    """Weights of pairs (a < b) of numbers under `size`, summed as they come, a bounded number at once."""

    def __init__(self, size: int):
        self.size, self.key, self.weight, self.waiting, self.held = size, np.zeros(0, np.int64), np.zeros(0), [], 0

    def add(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray):
        self.waiting.append((np.minimum(a, b) * self.size + np.maximum(a, b), weight))
        self.held += len(a)
        if self.held > max(4 * _MOST, len(self.key)):
            self._sum()

    def _sum(self):
        key, weight = (np.concatenate(x) for x in zip((self.key, self.weight), *self.waiting))
        self.key, at = np.unique(key, return_inverse=True)
        self.weight, self.waiting, self.held = np.bincount(at, weight, len(self.key)), [], 0

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._sum()
        return self.key // max(1, self.size), self.key % max(1, self.size), self.weight

    def add_within(self, group: np.ndarray, what: np.ndarray, value: np.ndarray):
        """All pairs in each group (rows are sorted by group), with the products of their values."""
        count = np.diff(np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))) if len(group) else np.zeros(0, np.int64)
        _, place = _spread(count)
        i, upto = 0, np.cumsum(place)
        while i < len(place):  # row k meets the `place` rows of its group before it
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _MOST, side="right")))
            k, back = _spread(place[i:j])
            k += i
            other = k - 1 - back
            self.add(what[other], what[k], value[other] * value[k])
            i = j


class _Batch:
    """Tokens of documents' chunks as numbers. A word is a token of a document, in their order; `own` has each chunk's distinct words."""

    def __init__(self, chunks: np.ndarray, count: np.ndarray, code: np.ndarray, names: list[str], asked: np.ndarray, asked_code: np.ndarray, has: np.ndarray):
        """chunks: each document's; count: each chunk's tokens; code: all tokens as places in names, which are sorted; asked, asked_code: the same of the queries."""
        self.docs, self.chunks, self.count, self.names = len(chunks), chunks, count, names
        self.doc, _ = _spread(chunks)  # of each chunk
        self.starts = np.cumsum(chunks) - chunks
        self.chunk, place = _spread(count)  # of each token
        self.pos = place + 1
        who, _ = _spread(asked)
        width = max(1, len(names))
        key, self.word = np.unique(self.doc[self.chunk] * width + code, return_inverse=True)
        self.words, self.word_doc, self.code = len(key), key // width, key % width
        want = np.unique(who * width + asked_code)
        want = want[has[want // width]]
        self.wanted = np.isin(key, want)  # words that are in their document's query
        self.asks = np.bincount(want // width, minlength=self.docs)  # distinct tokens of its query
        key, self.at, self.tf = np.unique(self.chunk * max(1, self.words) + self.word, return_inverse=True, return_counts=True)
        self.own_chunk, self.own = key // max(1, self.words), key % max(1, self.words)
        self.distinct = np.bincount(self.own_chunk, minlength=len(self.doc))
        self.df = np.bincount(self.own, minlength=self.words)

    @classmethod
    def nested(cls, chunks: pa.Array, query: pa.Array, has: np.ndarray) -> _Batch:
        inner, asked = chunks.flatten(), query.flatten()
        names, code = numbered(inner.flatten().to_pylist() + asked.to_pylist())
        n = len(code) - len(asked)
        return cls(_flat(chunks), _flat(inner), code[:n], names, _flat(query), code[n:], has)

    def strings(self, words: np.ndarray) -> pa.Array:
        """The texts of words."""
        return pa.array(self.names, pa.string()).take(pa.array(self.code[words]))

    def places(self, decay: float, first: bool) -> np.ndarray:
        """Of each own: the sum of 1/place, times decay to the power of the first place; or of 1/place times decay to that place's."""
        if not first:
            return np.bincount(self.at, 1 / self.pos * decay ** (self.pos - 1), len(self.own))
        low = np.full(len(self.own), np.iinfo(np.int64).max)
        np.minimum.at(low, self.at, self.pos)
        return np.bincount(self.at, 1 / self.pos, len(self.own)) * decay ** (low - 1)


def _flat(lists: pa.Array) -> np.ndarray:
    """The lengths of lists; nulls are empty."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _unit_tfidf(group: np.ndarray, n: np.ndarray, df: np.ndarray, tf: np.ndarray, r: Ranker) -> np.ndarray:
    """TF-IDF of rows, scaled to length 1 in each group."""
    idf = (np.log((1 + n) / (1 + df)) if r.smooth else np.log(n / df)) + 1
    raw = (1 + np.log(tf) if r.sublinear else tf) * idf
    return raw / np.sqrt(np.bincount(group, raw * raw))[group] if len(raw) else raw


def _graph_ranks(doc_of: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, damping: float, many: np.ndarray | None = None) -> np.ndarray:
    """Ranks of the nodes that have an edge, 0 of the others; each document's graph by itself."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    out = np.zeros(len(doc_of))
    if len(nodes):
        _, graph = np.unique(doc_of[nodes], return_inverse=True)
        out[nodes] = pageranks(graph, ends[: len(a)], ends[len(a) :], weight, damping, many=None if many is None else many[nodes])[0]
    return out


def _topic(b: _Batch, lower: _Batch, has: np.ndarray, r: Ranker) -> np.ndarray:
    n = lower.chunks + has
    in_query = lower.wanted.astype(np.int64)
    df = np.bincount(lower.own, minlength=lower.words) + in_query
    u = _unit_tfidf(lower.own_chunk, n[lower.word_doc[lower.own]], df[lower.own], lower.tf, r)
    order = np.lexsort((lower.own_chunk, lower.own))
    pairs = _Pairs(len(b.doc))
    pairs.add_within(lower.own[order], lower.own_chunk[order], u[order])
    x, y, w = pairs.sums()
    close = w >= r.least
    rank = _graph_ranks(b.doc, x[close], y[close], w[close], r.damping)
    linked = np.bincount(b.doc[x[close]], minlength=b.docs) > 0
    over = np.bincount(b.own_chunk, b.wanted[b.own], len(b.doc))
    boost = np.where(b.asks[b.doc] > 0, 1 + over / np.maximum(1, b.asks[b.doc]), 1.0)
    return np.where(linked[b.doc], rank * boost, 1 / np.maximum(1, b.chunks)[b.doc])


def alike(b: _Batch) -> np.ndarray:
    """The class of each word: words that occur in the same chunks, in each of them as often."""
    order = np.argsort(b.own, kind="stable")
    chunk, tf, start = b.own_chunk[order], b.tf[order], np.cumsum(b.df) - b.df
    _, out = np.unique(b.df, return_inverse=True)
    most, k = int(b.tf.max(initial=0)) + 1, 0
    live, made = np.arange(b.words), b.words
    while len(live):
        at = start[live] + k
        _, pair = np.unique(chunk[at] * most + tf[at], return_inverse=True)
        _, now = np.unique(out[live] * len(live) + pair, return_inverse=True)
        out[live] = now + made
        made, k = made + len(live), k + 1
        live = live[b.df[live] > k]
    return np.unique(out, return_inverse=True)[1]


def _semantic(b: _Batch, r: Ranker) -> np.ndarray:
    """Words' ranks. By the cosine, words that are alike have the same edges, so classes of them are ranked: a chunk of n words that are
    nowhere else is a class or a few, not n * n / 2 edges."""
    if r.similarity is None:
        of = alike(b)
        first = np.unique(of, return_index=True)[1]  # a word of each
        many = np.bincount(of).astype(float)
        rows = np.flatnonzero(first[of[b.own]] == b.own) if len(b.own) else np.zeros(0, np.int64)
        pairs = _Pairs(len(first))
        tf = b.tf[rows].astype(float)
        pairs.add_within(b.own_chunk[rows], of[b.own[rows]], tf)
        x, y, w = pairs.sums()
        square = np.bincount(of[b.own[rows]], tf * tf, len(first))
        own = np.flatnonzero(many > 1)
        x, y, w, norm = np.concatenate([x, own]), np.concatenate([y, own]), np.concatenate([w, square[own]]), np.sqrt(square)
        w = w / (norm[x] * norm[y])
        near = w >= r.least
        return _graph_ranks(b.word_doc[first], x[near], y[near], w[near], r.damping, many)[of]
    x, y, w = _likeness(b, r)
    near = w >= r.least
    return _graph_ranks(b.word_doc, x[near], y[near], w[near], r.damping)


def _likeness(b: _Batch, r: Ranker) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a document's words, by the caller's similarity."""
    found = []
    for d in range(b.docs):
        mine = np.flatnonzero(b.word_doc == d)
        if len(mine):
            rows = np.flatnonzero(b.doc[b.own_chunk] == d)
            counts = np.zeros((len(mine), int(b.chunks[d])))
            counts[b.own[rows] - mine[0], b.own_chunk[rows] - b.starts[d]] = b.tf[rows]
            like = np.asarray(r.similarity(counts), float)
            i, j = np.triu_indices(len(mine), 1)
            found.append((mine[i], mine[j], like[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def cooccurrences(b: _Batch, window: int):
    """By distance up to `window`: the places of tokens that differ from those at this distance in their chunk, and the two words."""
    for d in range(1, window + 1):
        i = np.flatnonzero((b.chunk[d:] == b.chunk[:-d]) & (b.word[d:] != b.word[:-d])) if d < len(b.word) else np.zeros(0, np.int64)
        yield d, i, b.word[i], b.word[i + d]


def edges(b: _Batch, window: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of words, the first by order before the second, with the sum of 1/distance, where it reaches `least`."""
    pairs = _Pairs(b.words)
    for d, i, t, u in cooccurrences(b, window):
        pairs.add(t, u, np.full(len(i), 1 / d))
    x, y, w = pairs.sums()
    return tuple(v[w >= least] for v in (x, y, w))


def ranks_after(a: np.ndarray, b: np.ndarray, weight: np.ndarray, graph_of: np.ndarray, rounds: int, damping: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that have an edge, and their ranks after so many rounds, each graph by itself."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(nodes)
    src, dst = ends, np.concatenate([ends[len(a) :], ends[: len(a)]])
    w = np.concatenate([weight, weight])
    share = w / np.bincount(src, w, n)[src]
    size = np.bincount(graph_of[nodes])[graph_of[nodes]]
    x = 1 / np.maximum(1, size)
    for _ in range(rounds):
        x = damping * np.bincount(dst, x[src] * share, n) + (1 - damping) / size
    return nodes, x


def mean_tfidf(b: _Batch, r: Ranker) -> np.ndarray:
    """Of each word: TF-IDF, scaled to length 1 in each chunk, averaged over all chunks."""
    u = _unit_tfidf(b.own_chunk, b.chunks[b.word_doc[b.own]], b.df[b.own], b.tf, r)
    return np.bincount(b.own, u, b.words) / b.chunks[b.word_doc]


def ranked(b: _Batch, low: _Batch | None, has: np.ndarray, r: Ranker) -> np.ndarray:
    """A score for each chunk of all documents; low has the tokens of texts in lower case, for topicrank."""
    if not len(b.doc):
        return np.zeros(0)
    if r.kind == "topicrank":
        return _topic(b, low, has, r)
    weight, local = np.zeros(b.words), np.ones(len(b.own))
    if r.kind == "singlerank":  # of the first chunk alone
        rows = np.flatnonzero(b.own_chunk == b.starts[b.doc[b.own_chunk]])
        weight[b.own[rows]] = _unit_tfidf(b.own_chunk[rows], np.ones(len(rows)), np.ones(len(rows)), b.tf[rows], r)
    elif r.kind == "positionrank":
        local = b.places(r.decay, True)
    elif r.kind == "combined":
        if r.tfidf:
            weight = mean_tfidf(b, r)
        if r.position:
            local = b.places(r.decay, False)
    if r.kind == "semantic":
        rank = _semantic(b, r)[b.own]
    else:
        pairs = _Pairs(b.words)
        for d, i, t, u in cooccurrences(b, r.window):
            w = np.full(len(i), 1 / d)
            if r.kind == "singlerank":
                w *= weight[t] * weight[u]
            elif r.kind == "positionrank":
                w *= local[b.at[i]] * local[b.at[i + d]]
            elif r.kind == "combined":
                w = (weight[t] * weight[u] if r.tfidf else 1.0) * (w if r.position else np.ones(len(i)))
            if r.kind != "textrank":
                w = np.where(b.wanted[t] | b.wanted[u], 2 * w, w)
                t, u, w = (v[w >= r.least] for v in (t, u, w))  # each occurrence must reach it
            pairs.add(t, u, w)
        x, y, w = pairs.sums()
        if r.kind == "textrank":
            x, y, w = (v[w >= r.least] for v in (x, y, w))  # the sum must reach it
        rank = _graph_ranks(b.word_doc, x, y, w, r.damping)[b.own]
    wanted, asked = b.wanted[b.own], has[b.doc[b.own_chunk]]
    if r.kind in ("textrank", "semantic"):
        value = rank * (~asked | wanted)
    elif r.kind in ("singlerank", "positionrank"):
        value = rank * local * np.where(wanted, 3, 1)
    else:
        value = rank * ((weight[b.own] if r.tfidf else 1) * local + np.where(wanted, 2, 0))
    out = np.bincount(b.own_chunk, value, len(b.doc))
    return out / np.maximum(1, b.distinct) if r.kind == "combined" else out


def batch_scores(chunks: pa.Array, query: pa.Array, has: pa.Array, lower: pa.Array, low_query: pa.Array, r: Ranker) -> pa.Array:
    """list<double>: for each document a score for each of its chunks, given their tokens and those of its query. Words without an
    edge and graphs whose ranks don't converge give zeros."""
    has, n = np.asarray(has.fill_null(False), bool), _flat(chunks)
    tokens = np.concatenate([[0], np.cumsum(_flat(chunks.flatten()))])[np.concatenate([[0], np.cumsum(n)])]
    out, i = [], 0
    while i < len(chunks):
        j = max(i + 1, int(np.searchsorted(tokens, tokens[i] + _MOST, side="right")) - 1)
        s = slice(i, j)
        low = _Batch.nested(lower.slice(i, j - i), low_query.slice(i, j - i), has[s]) if r.kind == "topicrank" else None
        out.append(ranked(_Batch.nested(chunks.slice(i, j - i), query.slice(i, j - i), has[s]), low, has[s], r))
        i = j
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(out) if out else np.zeros(0)))


def scores(chunks: list[list[str]], query: list[str], has_query: bool, r: Ranker, lower: list[list[str]] | None = None, low_query: list[str] | None = None) -> list[float]:
    """A score for each chunk of one document."""
    deep, flat = pa.list_(pa.list_(pa.string())), pa.list_(pa.string())
    tokens = pa.array([chunks], deep), pa.array([query], flat)
    low = pa.array([chunks if lower is None else lower], deep), pa.array([query if low_query is None else low_query], flat)
    return batch_scores(*tokens, pa.array([has_query]), *low, r).to_pylist()[0]


def pagerank_rounds(edges: DataFrame, keys: list[str], rounds: int = 10, damping: float = 0.85, cut: int = 5) -> DataFrame:
    """keys, token, rank: PageRank of every document's graph at once, a fixed number of rounds, for graphs too large for one task.

    edges: keys, src, dst, weight, each pair once. Each round is one join and one aggregate over rows that stay partitioned by keys.
    Shares are written once to the shared folder, and every `cut` rounds the ranks, so that plans don't grow.
    """
    both = edges.select(*keys, "src", "dst", "weight").union(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).repartition(*keys)
    share = table(both.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(*keys, "src"))).drop("weight"), "shares")
    size = share.groupBy(*keys).agg(F.countDistinct("src").alias("n"))
    nodes = share.select(*keys, F.col("src").alias("token")).distinct().join(size, keys)
    ranks, last = nodes.withColumn("rank", 1 / F.col("n")), None
    for k in range(1, rounds + 1):
        got = share.join(ranks.withColumnRenamed("token", "src"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("token"), "n").agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        ranks = got.select(*keys, "token", "n", (damping * F.col("in") + (1 - damping) / F.col("n")).alias("rank"))
        if k % cut == 0 and k < rounds:
            ranks, old = table(ranks, "ranks"), last
            last = ranks
            if old is not None:
                drop(old)
    return ranks.select(*keys, "token", "rank")
