"""Scores, graphs and selections against hand-worked values and plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistline.operators import graph, selection, terms
from gistline.operators.graph import Ranker, pagerank, scores
from gistline.operators.running import running_total
from gistline.plans.compress import METHODS, Options, chunked, compress, compress_all, compress_both, scored


def ready(spark, chunks, query=None):
    """Chunks given as token lists."""
    return spark.createDataFrame([(1, [" ".join(c) for c in chunks], chunks, list(dict.fromkeys(query or [])), query is not None)], "doc_id long, chunks array<string>, chunk_tokens array<array<string>>, query_tokens array<string>, has_query boolean")


CHUNKS = [["aa", "bb", "aa"], ["bb", "cc"], ["dd"], [], ["aa", "cc", "dd", "cc"]]


def plain_bm25(chunks, query, k1=1.5, b=0.75):
    n, avg = len(chunks), sum(map(len, chunks)) / len(chunks)
    df = Counter(t for c in chunks for t in set(c))
    out = []
    for c in chunks:
        tf = Counter(c)
        use = set(c) if query is None else set(query) & set(c)
        out.append(sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(c) / avg)) for t in use))
    return out


@pytest.mark.parametrize("query", [None, ["aa", "zz"], []])
def test_bm25_and_tfidf(spark, query):
    from gistline.operators import scoring

    r = ready(spark, CHUNKS, query)
    got = scoring.bm25(r, ["doc_id"]).first().scored
    assert [c.idx for c in got] == [0, 1, 2, 3, 4] and np.allclose([c.score for c in got], plain_bm25(CHUNKS, query))
    df = Counter(t for c in CHUNKS for t in set(c))
    want = [sum(c.count(t) / len(c) * math.log(len(CHUNKS) / (1 + df[t])) for t in (set(c) if query is None else set(query) & set(c))) for c in CHUNKS]
    assert np.allclose([c.score for c in scoring.tfidf(r, ["doc_id"]).first().scored], want)


def test_one_exchange_only(spark):
    d = spark.createDataFrame([(1, "one two three. Four five six.")], "doc_id long, text string")
    plan = compress(d, Options("bm25", topn=2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_no_tokens_score_zero(spark):
    d = spark.createDataFrame([(1, "a b. C d! E f?")], "doc_id long, text string")
    assert {c.score for c in scored(d, Options("bm25", topn=1)).first().scored} == {0.0}


def test_position_weights(spark):
    r = ready(spark, [["x", "y", "x"]])
    first = {w.token: w.weight for w in terms.first_position_weights(r, ["doc_id"]).collect()}
    each = {w.token: w.weight for w in terms.each_position_weights(r, ["doc_id"]).collect()}
    assert first["x"] == pytest.approx(4 / 3) and first["y"] == pytest.approx(0.5 * 0.95)
    assert each["x"] == pytest.approx(1 + 0.95**2 / 3) and each["y"] == pytest.approx(0.5 * 0.95)


def test_pagerank_by_hand():
    assert np.allclose(pagerank(2, np.array([0]), np.array([1]), np.array([3.0])), [0.5, 0.5])
    got = pagerank(3, np.array([0, 1]), np.array([1, 2]), np.array([1.0, 1.0]))
    mid = (1 - 0.85) / 3 + 0.85  # x1 = t + d(x0 + x2), x0 = x2 = t + d x1 / 2
    t, d = 0.05, 0.85
    assert got[1] == pytest.approx((t + 2 * d * t) / (1 - d * d), abs=1e-5) and got.sum() == pytest.approx(1) and mid
    assert len(pagerank(0, *[np.zeros(0, int)] * 2, np.zeros(0))) == 0


def test_pageranks_of_many_graphs_as_of_each(spark):
    r = np.random.default_rng(2)
    sizes, a, b, w, graph_of, alone = [2, 3, 9, 30, 4], [], [], [], [], []
    for g, n in enumerate(sizes):
        x, y = np.triu_indices(n, 1)
        some = r.random(len(x)) < max(0.3, 2 / n)
        some[: n - 1] = True
        v = r.random(some.sum()) + 0.1
        alone.append(pagerank(n, x[some], y[some], v))
        a.append(x[some] + len(graph_of)), b.append(y[some] + len(graph_of)), w.append(v)
        graph_of += [g] * n
    ranks, done = graph.pageranks(np.array(graph_of), np.concatenate(a), np.concatenate(b), np.concatenate(w))
    assert done.all() and np.allclose(ranks, np.concatenate(alone))


@pytest.mark.parametrize("damping", [0.9, 0.95])
def test_ranks_that_do_not_converge_are_zeros(spark, damping):
    path = [["aa", "bb", "cc"]]
    assert scores(path, [], False, Ranker("textrank", window=1, damping=damping)) == [0.0]
    assert scores(path, [], False, Ranker("textrank", window=1))[0] == pytest.approx(1, abs=1e-4)
    d = spark.createDataFrame([(1, "alpha beta gamma. Then others come."), (2, TEXT)], "doc_id long, text string")
    got = {r.doc_id: r for r in compress(d, Options("dedicated_textrank", topn=1, window=1, damping=damping, chunk_length=8)).collect()}
    assert set(got) == {1, 2} and got[1].compressed_text


def test_a_batch_as_each_document_alone(spark):
    import pyarrow as pa

    r = random.Random(7)
    docs_ = [[[r.choice("abcdefgh") * 2 for _ in range(r.randrange(0, 9))] for _ in range(r.randrange(0, 5))] for _ in range(40)]
    asked = [[r.choice("abcdefghz") * 2 for _ in range(r.randrange(0, 3))] for _ in docs_]
    asked = [list(dict.fromkeys(q)) for q in asked]
    has = [r.random() < 0.7 for _ in docs_]
    deep, flat = pa.list_(pa.list_(pa.string())), pa.list_(pa.string())
    for kind in ("textrank", "singlerank", "positionrank", "combined", "topicrank", "semantic"):
        args = pa.array([None, *docs_], deep)[1:], pa.array(asked, flat), pa.array(has), pa.array(docs_, deep), pa.array(asked, flat)
        got = graph.batch_scores(*args, Ranker(kind)).to_pylist()
        for g, c, q, h in zip(got, docs_, asked, has):
            assert np.allclose(g, scores(c, q, h, Ranker(kind)))


def test_own_similarity_chunker_endings_and_tfidf(spark):
    chunks = [["aa", "bb"], ["bb", "cc"], ["dd"]]
    cosine = lambda m: (m @ m.T) / np.sqrt((m * m).sum(1))[:, None] / np.sqrt((m * m).sum(1))[None]
    assert np.allclose(scores(chunks, [], False, Ranker("semantic", similarity=cosine)), scores(chunks, [], False, Ranker("semantic")))
    all_ = scores(chunks, [], False, Ranker("semantic", similarity=lambda m: np.ones((len(m), len(m)))))
    assert all_[2] == pytest.approx(0.25)  # every word is like every other
    d = spark.createDataFrame([(1, "one thing|another thing|third thing")], "doc_id long, text string")
    o = Options("bm25", topn=1, chunker=lambda c: F.split(c, r"\|"))
    assert chunked(d, o).first().chunks == ["one thing", "another thing", "third thing"] and compress(d, o).count() == 1
    d = spark.createDataFrame([(1, "|".join(c * 20 for c in "一二三"))], "doc_id long, text string")
    assert [c[-1] for c in chunked(d, Options("bm25", topn=1, endings="|", chunk_length=25)).first().chunks] == ["|", "|", "三"]
    assert chunked(d, Options("bm25", topn=1, chunk_length=25)).first().chunks[-1].count("|") == 2
    two = [["aa", "aa", "bb"], ["bb", "cc"]]
    plain, other = (scores(two, [], False, Ranker("combined", position=False, least=0.0, smooth=s, sublinear=u)) for s, u in ((True, False), (False, True)))
    weights = lambda s, u: [{t: ((1 + math.log(n)) if u else n) * ((math.log(3 / (1 + df)) if s else math.log(2 / df)) + 1) for (t, n), df in zip(Counter(c).items(), [sum(t in x for x in two) for t in Counter(c)])} for c in two]
    for got, (s, u) in ((plain, (True, False)), (other, (False, True))):
        unit = [{t: v / math.sqrt(sum(x * x for x in w.values())) for t, v in w.items()} for w in weights(s, u)]
        mean = {t: sum(x.get(t, 0) for x in unit) / 2 for t in ("aa", "bb", "cc")}
        rank = dense_rank(plain_word_edges(two, lambda k, t, x, d: mean[t] * mean[x], 0.0, True))
        assert np.allclose(got, [sum(rank[t] * mean[t] for t in set(c)) / len(set(c)) for c in two], atol=1e-4)


def test_pagerank_of_all_documents_at_once(spark):
    edges = [(1, "a", "b", 1.0), (1, "b", "c", 2.0), (2, "a", "c", 1.0), (2, "c", "d", 0.5), (2, "a", "d", 4.0)]
    got = {(r.doc_id, r.token): r["rank"] for r in graph.pagerank_rounds(spark.createDataFrame(edges, "doc_id long, src string, dst string, weight double"), ["doc_id"], 12).collect()}
    for doc, names in ((1, "abc"), (2, "acd")):
        own = [e for e in edges if e[0] == doc]
        a, b = (np.array([names.index(e[k]) for e in own]) for k in (1, 2))
        x = np.full(3, 1 / 3)
        w = np.zeros((3, 3))
        for i, j, e in zip(a, b, own):
            w[i, j] = w[j, i] = e[3]
        for _ in range(12):
            x = 0.85 * (x / w.sum(1)) @ w + 0.05
        assert np.allclose([got[doc, t] for t in names], x)


def plain_word_edges(chunks, weight, least, before_sum, window=3):
    edges = defaultdict(float)
    for k, ts in enumerate(chunks):
        for i in range(len(ts)):
            for j in range(i + 1, min(len(ts), i + window + 1)):
                if ts[i] != ts[j]:
                    w = weight(k, ts[i], ts[j], j - i)
                    if not before_sum or w >= least:
                        edges[frozenset((ts[i], ts[j]))] += w
    return {e: w for e, w in edges.items() if before_sum or w >= least}


def dense_rank(edges):
    names = sorted({t for e in edges for t in e})
    if not names:
        return {}
    w = np.zeros((len(names),) * 2)
    for e, v in edges.items():
        a, b = (names.index(t) for t in e)
        w[a, b] = w[b, a] = v
    p = w / w.sum(1, keepdims=True)
    x = np.linalg.solve(np.eye(len(names)) - 0.85 * p.T, np.full(len(names), 0.15 / len(names)))
    return dict(zip(names, x))


@pytest.mark.parametrize("seed", range(6))
def test_word_rankers_against_linear_solve(seed):
    r = random.Random(seed)
    chunks = [[r.choice("abcdefgh") * 3 for _ in range(r.randrange(0, 12))] for _ in range(4)]
    chunks[0] = chunks[0] or ["aaa", "bbb"]
    q = ["aaa", "ccc"]
    for query in (None, q):
        boost = lambda t, u: 2 if query and (t in q or u in q) else 1
        over = lambda c: set(c) & set(q) if query else set()
        rank = dense_rank(plain_word_edges(chunks, lambda k, t, u, d: 1 / d, 0.1, False))
        want = [sum(rank.get(t, 0) for t in (over(c) if query else set(c))) for c in chunks]
        assert np.allclose(scores(chunks, query or [], query is not None, Ranker("textrank")), want, atol=1e-4)

        norm = math.sqrt(sum(v * v for v in Counter(chunks[0]).values()))
        unit = {t: v / norm for t, v in Counter(chunks[0]).items()}
        rank = dense_rank(plain_word_edges(chunks, lambda k, t, u, d: unit.get(t, 0) * unit.get(u, 0) / d * boost(t, u), 0.1, True))
        want = [sum(rank.get(t, 0) for t in set(c)) + sum(2 * rank.get(t, 0) for t in over(c)) for c in chunks]
        assert np.allclose(scores(chunks, query or [], query is not None, Ranker("singlerank")), want, atol=1e-4)

        at = [{t: [p for p, x in enumerate(c, 1) if x == t] for t in c} for c in chunks]
        pw = [{t: sum(1 / p for p in ps) * 0.95 ** (min(ps) - 1) for t, ps in a.items()} for a in at]
        rank = dense_rank(plain_word_edges(chunks, lambda k, t, u, d: pw[k][t] * pw[k][u] / d * boost(t, u), 0.1, True))
        want = [sum(rank.get(t, 0) * pw[k][t] for t in set(c)) + sum(2 * rank.get(t, 0) * pw[k][t] for t in over(c)) for k, c in enumerate(chunks)]
        assert np.allclose(scores(chunks, query or [], query is not None, Ranker("positionrank")), want, atol=1e-4)

        ew = [{t: sum(1 / p * 0.95 ** (p - 1) for p in ps) for t, ps in a.items()} for a in at]
        rank = dense_rank(plain_word_edges(chunks, lambda k, t, u, d: 1 / d * boost(t, u), 0.1, True))
        want = [(sum(rank.get(t, 0) * ew[k][t] for t in set(c)) + sum(2 * rank.get(t, 0) for t in over(c))) / max(1, len(set(c))) for k, c in enumerate(chunks)]
        assert np.allclose(scores(chunks, query or [], query is not None, Ranker("combined", tfidf=False)), want, atol=1e-4)


def test_thresholds():
    assert scores([["a1", "b1"]], [], False, Ranker("textrank", least=1.5)) == [0.0]  # one pair of weight 1
    assert scores([["a1", "b1", "a1", "b1"]], [], False, Ranker("textrank", least=1.5))[0] > 0  # the sum reaches it
    assert scores([["a1", "b1", "a1", "b1"]], [], False, Ranker("combined", tfidf=False, position=False, least=1.5)) == [0.0]


def test_topic_and_semantic():
    chunks = [["a", "b"], ["a", "b"], ["c"], ["a", "c"]]
    got = scores(chunks, [], False, Ranker("topicrank"))
    assert got[0] == pytest.approx(got[1]) and sum(got) == pytest.approx(1)
    assert scores([["a"], ["b"]], [], False, Ranker("topicrank")) == [0.5, 0.5]
    asked = scores([["a"], ["b"]], ["a", "x"], True, Ranker("topicrank"))
    assert asked == [0.5, 0.5]  # without edges the query has no say
    assert scores([["a", "b"], ["a"], ["z"]], [], False, Ranker("semantic"))[2] == 0.0
    assert scores([], [], False, Ranker("topicrank")) == []


def pick(spark, how, items):
    df = spark.createDataFrame([([(i, float(s), "x" * n) for i, (s, n) in enumerate(items)],)], "scored array<struct<idx:int,score:double,chunk:string>>")
    return [c.idx for c in df.select(how(F.col("scored")).alias("p")).first().p]


def test_selections(spark):
    items = [(3, 400), (2, 200), (1, 100)]
    assert pick(spark, lambda s: selection.until_full(s, 512), items) == [0]
    assert pick(spark, lambda s: selection.while_fitting(s, 512), items) == [0, 2]
    assert pick(spark, lambda s: selection.top(s, 2), [(1, 5), (2, 5), (2, 5)]) == [1, 2]
    assert pick(spark, lambda s: selection.either(selection.while_fitting(s, 512), selection.top(s, 2)), items) == [0, 2, 1]
    r = random.Random(2)
    for _ in range(10):
        items = [(r.randrange(5), r.randrange(1, 60)) for _ in range(r.randrange(1, 15))]
        order, used, stop, skip, open_ = sorted(range(len(items)), key=lambda i: (-items[i][0], i)), 0, [], [], True
        total = 0
        for i in order:
            open_ = open_ and total + items[i][1] <= 100
            if open_:
                total += items[i][1]
                stop.append(i)
            if used + items[i][1] <= 100:
                used += items[i][1]
                skip.append(i)
        assert pick(spark, lambda s: selection.until_full(s, 100), items) == stop
        assert pick(spark, lambda s: selection.while_fitting(s, 100), items) == skip


def test_options():
    for bad in ({"method": "none", "topn": 1}, {}, {"topn": 0}, {"max_length": -1}, {"topn": 1, "damping": 1.0}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert Options("textrank", topn=1).ranker == Ranker("combined", tfidf=False, position=False)
    assert Options("dedicated_textrank", topn=1).ranker.kind == "textrank"


TEXT = "Cats chase mice daily. Dogs chase cats sometimes! Mice fear cats; mice hide. Birds sing songs, birds fly. " * 3


def test_every_method(spark):
    d = spark.createDataFrame([(1, TEXT, "cats mice"), (2, "", "x"), (3, None, "x"), (4, " \n", None), (5, "Short.", None)], "doc_id long, text string, query string")
    for m in METHODS:
        rows = {r.doc_id: r for r in compress_all(d, Options(m, topn=1, chunk_length=8), "query").collect()}
        assert set(rows) == {1, 2, 3, 4, 5} and [rows[i].status for i in (1, 2, 3, 4, 5)] == ["ok", "empty", "empty", "empty", "ok"]
        assert rows[5].compressed_text == "Short." and rows[5].compression_ratio == 1.0
        chosen = rows[1].selected_chunks
        assert len(chosen) == 1 and len(rows[1].topic_scores) >= 1 and rows[1].compressed_text == "".join(chosen)


def test_both_and_union(spark):
    d = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    r = compress_both(d, Options("bm25", max_length=60, topn=2, chunk_length=4)).first()
    assert len(r.by_length.compressed_text) <= 60 and len(r.by_topn.selected_chunks) == 2
    chunks = chunked(d, Options("bm25", topn=1, chunk_length=4)).first().chunks
    both = compress(d, Options("textrank", max_length=60, topn=2, chunk_length=4)).first().selected_chunks
    assert [c for c in chunks if c in both][: len(both)] and set(both) <= set(chunks)


def test_running_total(spark):
    d = spark.createDataFrame([(k, k % 7) for k in random.Random(1).sample(range(-500, 5000), 400)], "k long, v long")
    got = sorted((r.k, r.v, r.t) for r in running_total(d, "k", "v", "t", 16).collect())
    total = 0
    for k, v, t in got:
        total += v
        assert t == total
    assert running_total(d.limit(0), "k", "v", "t").count() == 0
