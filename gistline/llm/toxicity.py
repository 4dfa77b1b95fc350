"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a document are its hits in two lexicons and their densities, second-person words near hits and in all,
capitals, words in capitals, punctuation, exclamation marks, letters replaced by signs (runs of signs inside words and at
their starts), lexicon words so disguised, at their ends too, and its length. One lexicon is a parameter; the other, of word beginnings (4 to 10 bytes), is learned from labels.
Both it and the trees are fitted on at most `max_rows` labelled documents, those whose doc_id hashes lowest (a documented
bound). By another hash, three eighths of them teach the lexicon, as many the trees, a quarter the calibration.
Every document is scored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import column, drop, keyed, parts, ship, table, with_key

LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass trash scum scumbag clown clowns worthless loser losers pathetic disgusting "
    "garbage vermin filth filthy imbecile imbeciles cretin cretins dimwit halfwit jerk jerks bastard bastards bitch bitches asshole assholes "
    "shit shitty fuck fucking fucker motherfucker dickhead retard retarded parasite parasites subhuman degenerate lowlife coward cowards "
    "dummkopf trottel arschloch abschaum schwachkopf vollidiot idioten imbécile connard connasse salaud salope ordure abruti débile "
    "idiota idiotas imbécil estúpido estúpida basura escoria payaso patético gilipollas cabrón"
).split()
SECOND_PERSON = "you your yours yourself yourselves u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre ti tú usted ustedes vuestro".split()
NEAR, SHORTEST, LONGEST = 5, 4, 10
FEATURES = "hits density stems stem_density near_you you capitals shouted punctuation exclaimed disguised disguised_hits length".split()
_LEET = bytes.maketrans(b"013457@$!+", b"oieastasit")
_SIGN = np.zeros(256, bool)
_SIGN[list(b"013457@$!*+")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")] = True
_TOKEN = _SIGN | _LETTER
_TOKEN[list(b"0123456789")] = True
_EDGE = b"!*+$@"


def _disguise(lexicon: tuple[str, ...]) -> tuple[set[bytes], re.Pattern]:
    plain = {w.encode() for w in lexicon}
    masked = "|".join("".join(f"(?:{re.escape(c)}|\\*)" for c in w) for w in lexicon if len(w) > 3)
    return plain, re.compile(f"(?:{masked or '(?!)'})".encode())


def _disguised(token: bytes, plain: set[bytes], masked: re.Pattern, longest: int) -> bool:
    """Whether signs in the token stand for letters of a lexicon word; those at its edges may also be its punctuation."""
    if token[:1] == token[-1:] == b"*":  # emphasis
        token = token.strip(b"*")
    lead, tail = len(token) - len(token.lstrip(_EDGE)), len(token.rstrip(_EDGE))
    for i in range(max(0, tail - longest), lead + 1):
        for j in range(tail, min(len(token), i + longest) + 1):
            t = token[i:j]
            if (u := t.translate(_LEET)) in plain and u != t or b"*" in t and masked.fullmatch(u):
                return True
    return False


def disguises(w: words.Words, lexicon: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, the signs in runs before a letter, inside words and at their starts, and the lexicon words so disguised.

    Signs at a word's end are mostly punctuation: they aren't among the signs, but the words that they disguise are found.
    """
    n = len(w.offsets) - 1
    sign = np.flatnonzero(_SIGN[w.data])
    doc = np.searchsorted(w.offsets, sign, side="right") - 1
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(sign) > 1) | (np.diff(doc) > 0)])) if len(sign) else sign
    doc, start, size = doc[heads], sign[heads], np.diff(np.append(heads, len(sign)))
    end, low, high = start + size, w.offsets[doc], w.offsets[doc + 1]
    open_, shut = start > low, end < high
    before, after = w.data[start - open_], w.data[end - ~shut]  # a sign, at the document's edges
    beyond = shut & _LETTER[after]
    signs = np.bincount(doc, size * (beyond & (~open_ | _LETTER[before] | ~_TOKEN[before])), minlength=n)
    beside = beyond | open_ & _LETTER[before]
    doc, start, low, high = doc[beside], start[beside], low[beside], high[beside]
    breaks = np.concatenate([[-1], np.flatnonzero(~_TOKEN[w.data]), [len(w.data)]])
    at = np.searchsorted(breaks, start)
    first, once = np.unique(np.maximum(breaks[at - 1] + 1, low), return_index=True)
    last, doc = np.minimum(breaks[at], high)[once], doc[once]
    found, known = np.zeros(n), {}
    plain, masked = _disguise(lexicon)
    longest = max(map(len, plain), default=0)
    for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist()):
        token = w.data[a:b].tobytes()
        if len(token.strip(_EDGE)) <= longest:
            if token not in known:
                known[token] = _disguised(token, plain, masked, longest)
            found[d] += known[token]
    return signs, found


class Stems(NamedTuple):
    """A learned lexicon: hashes of word beginnings, sorted, and of their first SHORTEST bytes."""

    hashes: np.ndarray
    heads: np.ndarray


NO_STEMS = Stems(np.zeros(0, words.U), np.zeros(0, words.U))


def beginnings(w: words.Words, rows: np.ndarray, length: int, before: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the first bytes of the words in rows, which have as many; before: those of one byte less."""
    up = words.powers(length)[0]
    if before is not None:
        return before + words._BYTE[w.data[w.start[rows] + length - 1]] * up[length - 1]
    return sum((words._BYTE[w.data[w.start[rows] + k]] * up[k] for k in range(1, length)), words._BYTE[w.data[w.start[rows]]] * up[0])


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def stem_hits(w: words.Words, stems: Stems) -> np.ndarray:
    """The words that begin with one of the stems."""
    out = np.zeros(len(w.hash), bool)
    size = w.end - w.start
    rows = np.flatnonzero(size >= SHORTEST)
    if not len(stems.hashes) or not len(rows):
        return out
    h = beginnings(w, rows, SHORTEST)
    sieve = np.zeros(1 << 16, bool)
    sieve[(stems.heads >> words.U(40)) & words.U(0xFFFF)] = True
    some = sieve[(h >> words.U(40)) & words.U(0xFFFF)]
    rows, h = rows[some], h[some]
    for length in range(SHORTEST, LONGEST + 1):
        if length > SHORTEST:
            long = size[rows] >= length
            rows, h = rows[long], h[long]
            h = beginnings(w, rows, length, h)
        out[rows[_among(stems.hashes, h)]] = True
    return out


def features(texts: pa.Array, stems: Stems = NO_STEMS, lexicon: tuple[str, ...] = tuple(LEXICON)) -> np.ndarray:
    """A row of FEATURES for each text; zeros for nulls and empty texts."""
    w = words.words_of(texts)
    n = len(w.splits) - 1
    _, raw = words.buffers(texts)
    doc = words.document_of(w.splits)
    count = np.maximum(1, np.diff(w.splits))
    size = np.maximum(1, np.diff(w.offsets))

    hit, you = _among(np.unique(words.hash_words(list(lexicon))), w.hash), _among(np.unique(words.hash_words(SECOND_PERSON)), w.hash)
    stem = stem_hits(w, stems)
    seen = np.concatenate([[0], np.cumsum(you)])
    at = np.flatnonzero(hit | stem)
    near = seen[np.minimum(at + NEAR + 1, w.splits[doc[at] + 1])] - seen[np.maximum(at - NEAR, w.splits[doc[at]])]
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    shouted = (upper[w.end] - upper[w.start] == w.end - w.start) & (w.end - w.start > 2)

    def per_doc(flags):
        upto = np.concatenate([[0], np.cumsum(flags)])
        return upto[w.offsets[1:]] - upto[w.offsets[:-1]]

    disguised, found = disguises(w, lexicon)
    hits, begun = np.bincount(doc[hit], minlength=n), np.bincount(doc[stem], minlength=n)
    all_ = [
        hits, hits / count, begun, begun / count, np.bincount(doc[at], near, minlength=n), np.bincount(doc[you], minlength=n) / count, per_doc((raw >= 65) & (raw <= 90)) / size,
        np.bincount(doc[shouted], minlength=n) / count, per_doc(_PUNCTUATION[raw]) / size, per_doc(raw == 33) / size, disguised / count, found, np.log1p(np.diff(w.splits)),
    ]
    return np.stack([np.asarray(x, np.float32) for x in all_], 1)


class Model(NamedTuple):
    base: float
    trees: list  # of (feature, threshold, left, right, value) arrays
    x: np.ndarray  # the calibration's margins, ascending
    y: np.ndarray  # and probabilities


def _tree(binned, edges, grad, hess, depth, least, ridge):
    feature, threshold, left, right, value = [-1], [0.0], [-1], [-1], [0.0]
    todo = [(0, np.arange(len(grad)), 0)]
    width = max(map(len, edges)) + 1
    while todo:
        node, rows, level = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        value[node] = -g / (h + ridge)
        if level == depth or len(rows) < 2 * least:
            continue
        best = (1e-6, None, None)
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            gs, hs, ns = np.bincount(b, grad[rows], width).cumsum()[:-1], np.bincount(b, hess[rows], width).cumsum()[:-1], np.bincount(b, minlength=width).cumsum()[:-1]
            gain = np.where((ns >= least) & (len(rows) - ns >= least), gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge), 0)
            k = int(gain.argmax())
            if gain[k] > best[0] and k < len(edges[f]):
                best = (gain[k], f, k)
        if best[1] is None:
            continue
        _, f, k = best
        goes = binned[rows, f] <= k
        feature[node], threshold[node], left[node], right[node] = f, float(edges[f][k]), len(feature), len(feature) + 1
        for part in (rows[goes], rows[~goes]):
            todo.append((len(feature), part, level + 1))
            for column_, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
                column_.append(v)
    return np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(right), np.array(value)


def _leaf(tree, x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = tree
    node = np.zeros(len(x), np.int64)
    while (inner := feature[node] >= 0).any():
        f = np.maximum(feature[node], 0)
        node = np.where(inner, np.where(x[np.arange(len(x)), f] <= threshold[node], left[node], right[node]), node)
    return value[node]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the non-decreasing means of y over them."""
    order = np.argsort(x, kind="stable")
    xs, start = np.unique(x[order], return_index=True)
    total, n = np.add.reduceat(y[order].astype(float), start), np.diff(np.append(start, len(x)))
    blocks: list[list[float]] = []
    for t, m in zip(total, n):
        blocks.append([t, m, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, m2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + m2, blocks[-1][2] + k2]
    return xs, np.concatenate([np.full(int(k), t / m) for t, m, k in blocks])


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 5, ridge: float = 1.0) -> Model:
    """Trees on the rows not held, calibration on those held. With one class only, a constant."""
    if not len(y) or y.min() == y.max():
        return Model(0.0, [], np.zeros(1), np.array([float(y.mean()) if len(y) else 0.0]))
    if y[~held].min(initial=1) == y[~held].max(initial=0) or not held.any():
        held = np.zeros(len(y), bool)
    fx, fy = x[~held], y[~held].astype(float)
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, 33)[1:-1], method="lower")) if len(np.unique(v)) > 32 else np.unique(v)[:-1] for v in fx.T]
    binned = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, fx.T)], 1)
    p = np.clip(fy.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin, out = np.full(len(fy), base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        feature, threshold, left, right, value = _tree(binned, edges, q - fy, q * (1 - q), depth, least, ridge)
        out.append((feature, threshold, left, right, rate * value))
        margin += _leaf(out[-1], fx)
    model = Model(base, out, np.zeros(1), np.zeros(1))
    rows = held if held.any() else ~held
    xs, ys = isotonic(margins(model, x[rows]), y[rows])
    return model._replace(x=xs, y=ys)


def margins(model: Model, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model.base)
    for t in model.trees:
        out += _leaf(t, x)
    return out


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    return np.interp(margins(model, x), model.x, model.y)


def _stem_batches(batches):
    """Rows (h, head, toxic, n): how many documents of a class have a word that begins so."""
    for b in parts(batches):
        w = words.words_of(b.column(1))
        size, label = w.end - w.start, b.column(2).to_numpy()
        rows, h, head, found = np.flatnonzero(size >= SHORTEST), None, None, []
        for length in range(SHORTEST, LONGEST + 1):
            if h is not None:
                long = size[rows] >= length
                rows, h, head = rows[long], h[long], head[long]
            h = beginnings(w, rows, length, h)
            head = h if head is None else head
            found.append((np.searchsorted(w.splits, rows, side="right") - 1, h, head))
        doc, h, head = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((doc, h))
        doc, h, head = doc[order], h[order], head[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h, head = doc[once], h[once], head[once]
        if not len(h):
            continue
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        toxic = np.add.reduceat(label[doc].astype(np.int64), heads)
        n = np.diff(np.append(heads, len(h)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[heads].view(np.int64), head[heads].view(np.int64), toxic, n)], ["h", "head", "toxic", "n"])


def learn_stems(texts: DataFrame, share: float, evidence: float = 13.0, purity: float = 0.7) -> Stems:
    """From rows (key, text, y), of which that share is toxic: beginnings whose documents are toxic far beyond that share
    (log likelihood ratio at least `evidence`, and at least that part of them toxic)."""
    if not 0 < share < 1:
        return NO_STEMS
    g = texts.mapInArrow(_stem_batches, "h long, head long, toxic long, n long").groupBy("h", "head").agg(F.sum("toxic").alias("t"), F.sum("n").alias("n"))
    p = F.col("t") / F.col("n")
    ratio = F.col("t") * F.log(p / share) + F.when(p < 1, (F.col("n") - F.col("t")) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    found = g.filter((F.col("t") > 0) & (p >= purity) & (ratio >= evidence)).select("h", "head").toPandas()
    return Stems(np.unique(found.h.to_numpy(np.int64).view(words.U)), np.unique(found["head"].to_numpy(np.int64).view(words.U)))


def _feature_batches(stems: Stems):
    def run(batches):
        for b in parts(batches):
            x = features(b.column(1), stems)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists], ["key", "last", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> tuple[Model, Stems]:
    """From labels (doc_id, toxic 0 or 1): rows with nulls don't count, of several for a document the greatest does."""
    spark = docs.sparkSession
    ship(spark)
    h = F.xxhash64(F.lit("toxicity"), "key")
    known = labels.select(column(labels, "doc_id").cast("long").alias("key"), column(labels, "toxic").cast("int").alias("y")).filter("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    sample = known.orderBy(h, "key").limit(max_rows)  # at most so many rows of two numbers are broadcast, at any size
    part = F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(8))
    texts = table(keyed(docs).join(F.broadcast(sample), "key").select("key", "text", "y", part.cast("int").alias("part")), "labelled")
    teach = texts.filter("part < 3")
    share = teach.agg(F.avg("y")).first()[0] or 0.0
    stems = learn_stems(teach.select("key", "text", "y"), share)
    rest = texts.filter("part >= 3").select("key", "text", F.struct("part", "y").alias("last"))
    got = rest.mapInArrow(_feature_batches(stems), "key long, last struct<part int, y int>, x array<float>").select("key", "last.part", "last.y", "x").toPandas()
    got = got.assign(x=[tuple(v) for v in got.x]).sort_values(["key", "y", "x"])
    x = np.array(got.x.tolist(), np.float32).reshape(-1, len(FEATURES))
    drop(texts)
    return fit(x, got.y.to_numpy(), (got.part >= 6).to_numpy()), stems


def _score_batches(model: Model, stems: Stems):
    def run(batches):
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(probabilities(model, features(b.column(1), stems)))], ["key", "th", "p"])

    return run


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    return keyed(docs).mapInArrow(_score_batches(*train(docs, labels, max_rows)), "key long, th int, p double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 20_000) -> DataFrame:
    """doc_id, toxicity (the calibrated probability), toxic (whether it reaches the threshold): a row for each of docs.

    Nulls and texts without a word have the features of an empty text. Rows without doc_id go by a negative number from
    their text's hash, and repeated rows are each scored. Without labels, or with one class of them, the probability is
    that class's share, 0 without any. Very long texts count whole. Columns other than doc_id and text don't matter.
    """
    return scored(docs, labels, max_rows).select(F.col("key").alias("doc_id"), F.col("p").alias("toxicity"), (F.col("p") >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 20_000) -> DataFrame:
    """docs without those that toxicity() finds toxic; rows equal in doc_id and text go or stay together, and all columns stay."""
    bad = table(scored(docs, labels, max_rows).filter(F.col("p") >= threshold).select("key", "th").distinct(), "toxic")
    d, k, th = with_key(docs)
    return d.join(bad.select(F.col("key").alias(k), F.col("th").alias(th)), [k, th], "left_anti").drop(k, th)
