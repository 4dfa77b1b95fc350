"""Documents by themselves: the cutting in Python against the column expressions, plans without exchanges of tokens, graphs that stay small."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistline.functions import chunking, cutting
from gistline.functions import text as T
from gistline.operators import graph, scoring, terms
from gistline.operators.graph import Ranker, scores
from gistline.operators.local import Docs, _cut
from gistline.queries import QUERIES, letters
from gistline.scratch import mark

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \n　", "a b. C d! E f?", "w, " * 100, "x" * 60 + " y", "no.a b. A z. U.S. x", "He said \"Go.\" Then left. (Really.) e.g. this… 你好。世界！好",
    "é.É è, ü;ö next word\x1cstill\x85new", "a1b2 12ab 3.14 ٣٤abc ½² Ⅷ ⓐⓑ x́y a‍b", "emoji 😀 words. 𝒜lpha 𐐀𐐁 end", "nul\0inside. And\0more", "one,two；three，four\nfive\n\n\n\nsix", "。" * 50 + "A" * 30 + "." * 20,
    "tail. " * 9 + "Z.", "11.11.11 a" * 20, "a.\n(b) c.[d] e.'f'",
]


def texts(n: int) -> list:
    r = random.Random(5)
    parts = ["word", "Ab", "x", "12", "3a", "é", "你好", ".", "!", "…", ",", ";", " ", " ", " ", "\n", "\t", "(", " ", "😀", "_", "́", "²", "longerwordthanmost" * 2]
    return ODD + ["".join(r.choice(parts) for _ in range(r.randrange(0, 200))) for _ in range(n)]


@pytest.mark.parametrize("most,endings,pdf", [(20, T.ENDINGS, False), (150, T.ENDINGS, True), (5, "|.]", False)])
def test_cutting_is_as_the_expressions(spark, most, endings, pdf):
    d = spark.createDataFrame(list(enumerate(texts(150))), "k long, t string")
    kept = {r.k: r for r in d.select("k", "t", chunking.chunks("t", most, endings=endings, pdf=pdf).alias("c"), T.segments("t", most, endings, pdf).alias("s"), T.tokens("t").alias("w"), T.weighted_length("t").alias("n")).collect()}
    got = {r.k: r.c for r in chunking.with_chunks(d, "t", most, name="c", endings=endings, pdf=pdf).collect()}
    for k, r in kept.items():
        assert cutting.segments(r.t, most, endings, pdf) == r.s and got[k] == r.c
        assert r.t is None or (cutting.tokens(r.t) == r.w and cutting.weighted_length(r.t) == r.n)
    some = [s for r in kept.values() for s in r.s]
    assert cutting.weighted_lengths(some).tolist() == [cutting.weighted_length(s) for s in some]


def test_words_are_those_of_the_jvm(spark):
    c = spark.range(1, 0x10000).filter("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    jvm = {r.id for r in c.filter(F.col("c").rlike(r"(?U)\w")).collect()}
    word = cutting._words(0x10000, 0)
    ours = {k for k in range(1, 0x10000) if not 0xD800 <= k <= 0xDFFF and word.match(chr(k))}
    assert not jvm - ours and not [k for k in ours - jvm if k < 0x800]  # Python may know letters of a later Unicode


def test_tokens_of_chunks_are_the_chunks_texts_tokens():
    cut = cutting.Cut(20)
    docs = texts(100)
    d = _cut(docs, [None] * len(docs), cut, True)
    made = [[cutting.tokens(c) for c in cutting.Chunks([t], cut).texts()] for t in docs]
    b = d.batch
    assert b.chunks.tolist() == [*map(len, made)] and b.count.tolist() == [len(c) for m in made for c in m]
    assert [b.names[x] for x in b.code[b.word]] == [w for m in made for c in m for w in c]
    assert [d.low.names[x] for x in d.low.code[d.low.word]] == [w for t in docs for c in cutting.Chunks([t], cut).texts() for w in cutting.tokens(c.lower())]


def plan_of(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


#: Queries whose results are a document's own: no exchange by key, no table on the way, no interpreted fold over segments.
ALONE = [
    "pagerank_fixed",
    "semantic_textrank",
    "document_frequency",
    "term_frequency",
    "tfidf_mean",
    "cooc_edges",
    "position_weights_first",
    "textrank",
    "position_weights_each",
    "combined_tt",
    "positionrank",
    "combined_ff",
    "query_overlap",
    "singlerank",
    "topicrank",
    "vocabulary",
]
#: Queries that exchange texts, as they are read, and no chunks or tokens.
EVEN = [
    "select_topn",
    "query_similarity",
    "bm25_noquery",
    "select_stop",
    "select_both",
    "tfidf_noquery",
    "select_skip",
    "bm25_query",
    "tfidf_query",
    "compress_both_ways",
]


@pytest.mark.parametrize("name", ALONE)
def test_no_exchange_by_key_or_table(spark, name):
    before, plan = mark(spark), plan_of(spark, name)
    assert "Exchange hashpartitioning" not in plan and "aggregate(" not in plan and mark(spark) == before


@pytest.mark.parametrize("name", EVEN)
def test_tokens_are_not_exchanged(spark, name):
    plan = plan_of(spark, name)
    above, below = plan.split("MapInArrow", 1)
    assert "Exchange" not in above and "Exchange hashpartitioning" in below and "aggregate(" not in below


def test_ranks_of_each_document_as_of_all_at_once(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(20).select("doc_id", "text")
    cut = cutting.Cut(20)
    rounds = graph.pagerank_rounds(terms.cooccurrence(d, ["doc_id"], cut=cut), ["doc_id"])
    want = {(r.doc_id, r.token): r["rank"] for r in rounds.collect()}
    got = {(r.doc_id, r.token): r["rank"] for r in terms.cooccurrence_ranks(d, ["doc_id"], cut=cut).collect()}
    assert want.keys() == got.keys() and np.allclose([want[k] for k in want], [got[k] for k in want])


def test_words_that_are_alike_are_one_node(spark, monkeypatch):
    edges = []
    real = graph.pageranks
    monkeypatch.setattr(graph, "pageranks", lambda g, a, *x, **k: edges.append(len(a)) or real(g, a, *x, **k))
    assert scores([[f"w{i}" for i in range(3000)]], [], False, Ranker("semantic"))[0] == pytest.approx(1) and edges == [1]
    cosine = lambda m: (m @ m.T) / np.sqrt((m * m).sum(1))[:, None] / np.sqrt((m * m).sum(1))[None]
    r = random.Random(3)
    for _ in range(20):
        chunks = [[f"w{r.randrange(12)}" for _ in range(r.randrange(6))] + [f"only{k}{i}" for i in range(r.randrange(4))] for k in range(r.randrange(1, 6))]
        assert np.allclose(scores(chunks, [], False, Ranker("semantic")), scores(chunks, [], False, Ranker("semantic", similarity=cosine)))


def test_chunks_of_the_same_terms_tie(spark):
    r = np.random.default_rng(1)
    value = r.random(19) * 3
    names = [[f"{x}{i:02d}" for i in range(19)] for x in "ab"]
    weight = dict(zip(names[0], value)) | dict(zip(names[1], value[r.permutation(19)]))
    b = graph._Batch.nested(pa.array([names]), pa.array([[]], pa.list_(pa.string())), np.array([False]))
    got = scoring._sums(lambda t, doc: np.array([weight[t.names[c]] for c in t.code[t.own]]))(Docs(b, None, np.array([False]), None))
    assert got[0] == got[1]
    assert scoring.rounded(np.array([0.5, -1.5, 2.25]), 0).tolist() == [1.0, -2.0, 2.0]


def test_letters_are_counted(spark):
    d = spark.createDataFrame([("Banana!",), ("",)], "t string").select(letters("t").alias("v")).collect()
    assert d[0].v[:2] == [3.0, 1.0] and sum(d[0].v) == 6 and d[1].v == [0.0] * 26
