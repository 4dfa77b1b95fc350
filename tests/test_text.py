"""Splitting, measuring, tokenising, chunking: hand-made cases, and plain Python written apart."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gistline.functions import chunking, segmenter
from gistline.functions import text as T


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<int>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(expr).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Pi is 3.14 today. Mr. Smith of U.S. fame said hi! OK?Yes; no.a b. A z.", ["Pi is 3.", "14 today.", "Mr.", "Smith of U.S. fame said hi!", "OK?", "Yes;", "no.a b. A z."]),
        ('He said "Go." Then left. (Really.) e.g. this… 你好。世界！好', ['He said "Go.', '" Then left.', "(Really.) e.g. this…", "你好。", "世界！", "好"]),
        ("", []), ("  \n ", []), ("...", ["..."]), ("no end", ["no end"]), ("line\nline", ["line\nline"]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, T.sentences("t"), t=text) == want


def test_own_endings(spark):
    assert one(spark, T.sentences("t", "|]"), t="a|b]c. D!e") == ["a|", "b]", "c. D!e"]


def test_segments(spark):
    t = "short one. " + "word " * 30 + ", tail part, " + "x" * 50 + " y"
    got = one(spark, T.segments("t", 40), t=t)
    assert got[0] == "short one." and all(len(s) <= 40 for s in got if " " in s) and "" in got and "x" * 50 in got
    assert one(spark, T.space_pieces("t", 5), t="abcdefgh ij k lmnop") == ["", "abcdefgh", "ij k", "lmnop"]
    assert one(spark, T.comma_pieces("t"), t="a, b;c，d\ne") == ["a,", "b;", "c，", "d", "e"]
    assert one(spark, T.segments("t", pdf=True), t="a\n\n\n\nb   c") == ["a b c"]
    assert one(spark, T.segments("t"), t=None) == []


def test_weighted_length(spark):
    assert one(spark, T.weighted_length("t"), t="abc12def 34 x9y 中文a1 ,. 12ab") == 4
    assert one(spark, T.weighted_length("t"), t="w, " * 100) == 146
    assert one(spark, T.weighted_length("t"), t="") == 0


def test_tokens(spark):
    assert one(spark, T.tokens("t"), t="The cat and the dog, über_x a1b it's é") == ["The", "cat", "dog", "über_x", "a1b"]
    assert one(spark, T.query_terms("t"), t=" what? who ?? ") == ["what", "who"]
    assert [one(spark, T.language("t"), t=t) for t in ("hello there", "你好 ok", "123", "")] == ["en", "zh", None, None]


def test_excerpt_and_html(spark):
    assert len(one(spark, T.excerpt("t", 10, "t"), t="abc" * 50)) == 10
    assert one(spark, T.excerpt("t", 10, "t"), t="abc") == "abc" and one(spark, T.excerpt("t", 10, "t"), t="") is None
    html = one(spark, T.highlighted(F.array("a", "b")), a="<x> & 'y'\t", b="1\n2")
    assert "&lt;x&gt; &amp; &#x27;y&#x27;" + "&nbsp;" * 4 in html and "1<br>2" in html and html.count("<span") == 2
    with pytest.raises(ValueError):
        T.excerpt("t", 0, "t")


def plain_ranges(lengths, most, overlap):
    out, cur, total = [], [], 0
    for i, n in enumerate(lengths):
        if n > most:
            if cur:
                out.append((cur[0], cur[-1]))
            out.append((i, i))
            cur, total = [], 0
            continue
        if cur and total + n > most:
            out.append((cur[0], cur[-1]))
            keep = [cur[-1]]
            for j in reversed(cur[:-1]):
                if sum(lengths[k] for k in keep) + lengths[j] > overlap:
                    break
                keep.insert(0, j)
            cur, total = keep, sum(lengths[k] for k in keep)
        cur, total = cur + [i], total + n
    return out + ([(cur[0], cur[-1])] if cur else [])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 40), max_size=30), min_size=1, max_size=20))
def test_chunk_ranges(spark, cases):
    df = spark.createDataFrame([(c,) for c in cases], "l array<int>").select("l", chunking.chunk_ranges(F.col("l"), 30, 10).alias("r"))
    for row in df.collect():
        assert [(r.a, r.b) for r in row.r] == plain_ranges(row.l, 30, 10)


def test_short_tail_joins_the_chunk_before(spark):
    got = one(spark, chunking.chunks("t", 20), t="。".join("甲乙丙丁戊己庚辛" for _ in range(6)) + "。尾。")
    assert len(got) >= 2 and got[-1].endswith("尾。") and re.search("甲.* 尾。", got[-1])


def test_filter_on_chunks_plans_at_once(spark):
    d = chunking.with_chunks(spark.createDataFrame([(1, "a. B c."), (2, "")], "doc_id long, text string"))
    assert [r.doc_id for r in d.filter(F.size("chunks") > 0).collect()] == [1]


def test_chinese_segmenter(spark):
    words = {"北京": "ns", "大学": "n", "北京大学": "nt", "非常": "d", "他们": "r", "好看": "a"}
    assert segmenter.segment("他们在北京大学abc", words, 4) == [("他们", "r"), ("在", "x"), ("北京大学", "nt"), ("abc", "eng")]
    tok = segmenter.chinese_tokens(words, ("非常",))
    assert one(spark, tok(F.col("t")), t="他们在北京大学,非常好看abc") == ["北京大学", "好看", "abc"]


def test_highlight_of_what_is_at_hand(spark, capsys):
    from gistline.sources.embedding import hashed, print_embeddings

    class Page:
        page_content = "c\td"

    chunks = ["a <b>", ["x", "y"], Page()]
    want = spark.createDataFrame([(["a <b>", "x y", "c\td"],)], "chunks array<string>").select(T.highlighted("chunks").alias("h")).first().h
    assert T.highlight(chunks) == want
    with pytest.raises(TypeError):
        T.highlight([5])
    print_embeddings(["one two", "two"], hashed(4), 1)
    assert len(capsys.readouterr().out.splitlines()) == 2
