"""Documents shortened to their best chunks: options, methods by name, and the whole plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import OVERLAP, with_chunks
from ..functions.cutting import Cut
from ..functions.stopwords import ENGLISH
from ..functions.text import ENDINGS, tokens
from ..operators import scoring, selection
from ..operators.graph import Ranker
from ..operators.terms import prepared
from ..sources.files import PARTS, with_parts

CHUNK_LENGTH = {"en": 150, "zh": 128}

#: The word-graph methods by the names of the command line: one scorer, by two flags.
COMBINED = {"textrank": (False, False), "singlerank": (True, False), "positionrank": (False, True), "pos+tfidfrank": (True, True)}
#: The methods proper of those names.
DEDICATED = {"dedicated_textrank": "textrank", "dedicated_singlerank": "singlerank", "dedicated_positionrank": "positionrank", "topicrank": "topicrank", "semantic_textrank": "semantic"}
METHODS = ("bm25", "tfidf", *COMBINED, "combined", *DEDICATED)


@dataclass(frozen=True)
class Options:
    """method: one of METHODS. At least one of max_length (characters) and topn; where a method takes one alone, max_length counts."""

    method: str = "bm25"
    max_length: int | None = None
    topn: int | None = None
    chunk_length: int = 150
    overlap: int = OVERLAP
    k1: float = 1.5
    b: float = 0.75
    window: int = 3
    damping: float = 0.85
    min_edge: float = 0.1
    decay: float = 0.95
    use_tfidf: bool = True
    use_position: bool = True
    stopwords: tuple[str, ...] = field(default=ENGLISH, repr=False)
    pdf: bool = False
    tokenizer: object = None  # a function from a string column to an array<string> column, instead of the English one
    endings: str = ENDINGS  # characters that end a sentence, besides the dot
    chunker: object = None  # a function from a string column to an array<string> column of chunks, instead of ours
    similarity: object = None  # for semantic_textrank: from a words x chunks matrix of counts to a words x words matrix; the cosine by default
    smooth_idf: bool = True  # of the TF-IDF that weighs edges, for graph methods
    sublinear_tf: bool = False

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method {self.method!r} is none of {', '.join(METHODS)}")
        if self.max_length is None and self.topn is None:
            raise ValueError("max_length or topn must be given")
        for name in ("max_length", "topn", "chunk_length", "window"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if not 0 < self.damping < 1 or self.overlap < 0:
            raise ValueError("damping must lie between 0 and 1, overlap not below 0")

    @property
    def skips(self) -> bool:
        """Combined scorers skip what doesn't fit, and join both selections; the others stop at it."""
        return self.method in COMBINED or self.method == "combined"

    @property
    def cut(self) -> Cut | None:
        """How texts are cut on the way to their scores; None with a caller's chunker or tokeniser, which are expressions."""
        return None if self.chunker or self.tokenizer else Cut(self.chunk_length, self.overlap, self.endings, self.pdf, frozenset(self.stopwords))

    @property
    def ranker(self) -> Ranker:
        flags = COMBINED.get(self.method, (self.use_tfidf, self.use_position))
        return Ranker(DEDICATED.get(self.method, "combined"), self.window, self.damping, self.min_edge, *flags, self.decay, self.similarity, self.smooth_idf, self.sublinear_tf)


def chunked(docs: DataFrame, o: Options, query: str | None = None) -> DataFrame:
    if o.chunker:
        cut = docs.withColumn("chunks", F.coalesce(o.chunker(F.col("text")), F.array().cast("array<string>")))
    else:
        cut = with_chunks(docs, "text", o.chunk_length, o.overlap, pdf=o.pdf, endings=o.endings)
    d = prepared(cut, query, stopwords=o.stopwords)
    if o.tokenizer:
        q = F.col(query) if query else F.lit("")
        d = d.withColumns({"chunk_tokens": F.transform("chunks", o.tokenizer), "query_tokens": F.array_distinct(o.tokenizer(F.coalesce(q, F.lit(""))))})
    if o.method == "topicrank":
        lower = o.tokenizer or (lambda c: tokens(c, o.stopwords))
        q = F.lower(F.col(query)) if query else F.lit("")
        d = d.withColumns({"lower_tokens": F.transform("chunks", lambda c: lower(F.lower(c))), "lower_query": lower(F.coalesce(q, F.lit("")))})
    return d


def scored(docs: DataFrame, o: Options, query: str | None = None, keys: tuple[str, ...] = ("doc_id",), texts: bool = True) -> DataFrame:
    """keys, text_length, scored array<struct<idx, score, chunk>>, for documents that have a chunk. Without texts, chunk may be null."""
    keys = [*keys, "text_length"]
    d = docs.filter(F.col("text").rlike(r"(?U)\S")).withColumn("text_length", F.length("text"))
    if o.cut:
        d = d.select(*dict.fromkeys([*keys, "text", *([query] if query else [])]))
    how = {"cut": o.cut, "query": query, "texts": texts} if o.cut else {}
    if o.method in ("bm25", "tfidf"):
        d = d.repartition(*keys[:-1])  # texts alone, so that however files are cut up, the work is even
    ready = d if o.cut else chunked(d, o, query)
    if o.method == "bm25":
        return scoring.bm25(ready, keys, o.k1, o.b, **how)
    if o.method == "tfidf":
        return scoring.tfidf(ready, keys, **how)
    return scoring.graph_scores(ready, keys, o.ranker, **how)


def picked(o: Options) -> Column:
    s = F.col("scored")
    fit = selection.while_fitting if o.skips else selection.until_full
    by_length = fit(s, o.max_length) if o.max_length is not None else None
    by_rank = selection.top(s, o.topn) if o.topn is not None else None
    if by_length is None:
        return by_rank
    return selection.either(by_length, by_rank) if by_rank is not None and o.skips else by_length


def assembled(scores: DataFrame, picks: dict[str, Column]) -> DataFrame:
    """scores with, for each name, a struct<compressed_text, compression_ratio, selected_chunks> of that pick."""
    names = list(picks)
    d = reduce(lambda d, n: d.withColumn(f"__{n}", selection.in_order(picks[n])), names, scores)
    for n in names:
        text = F.array_join(f"__{n}", "")
        d = d.withColumn(n, F.struct(text.alias("compressed_text"), (F.length(text) / F.col("text_length")).alias("compression_ratio"), F.col(f"__{n}").alias("selected_chunks"))).drop(f"__{n}")
    return d


def compress(docs: DataFrame, o: Options, query: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, compressed_text, compression_ratio, selected_chunks, topic_scores (all chunks' scores, in order) of docs (keys, text, query).

    keys tell the rows apart. A null or empty text, or one without a segment, gives no row; compress_all() adds those.
    """
    d = assembled(scored(docs, o, query, keys), {"r": picked(o)})
    return d.select(*keys, "r.*", F.transform("scored", lambda c: c["score"]).alias("topic_scores"))


def compress_all(docs: DataFrame, o: Options, query: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """compress() with a row for every document, and its status: ok, or empty for what has nothing to choose from."""
    done = compress(docs, o, query, keys)
    out = docs.select(*keys).join(done, list(keys), "left")
    return out.select(*keys, F.coalesce("compressed_text", F.lit("")).alias("compressed_text"), "compression_ratio", "selected_chunks", "topic_scores", F.when(F.col("compressed_text").isNull(), "empty").otherwise("ok").alias("status"))


def compress_both(docs: DataFrame, o: Options, query: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, by_length, by_topn: both selections from one scoring; o has max_length and topn."""
    if o.max_length is None or o.topn is None:
        raise ValueError("both max_length and topn are needed")
    picks = {"by_length": picked(replace(o, topn=None)), "by_topn": picked(replace(o, max_length=None))}
    return assembled(scored(docs, o, query, keys), picks).select(*keys, "by_length", "by_topn")


def batch(manifest: DataFrame, texts: DataFrame, o: Options, use_query: bool = True, embed=None, parts: int = PARTS) -> DataFrame:
    """The batch job: for each query of the manifest (file_name, query) and each part of its file, both selections.

    texts: (file_name, text), the parts by their own names. embed: a function from a string column to a vector column; with it
    the similarities are the vectors' dot products, else null.
    """
    from ..functions.text import dot, query_terms

    terms = query_terms("query") if use_query else F.array(F.lit(""))
    jobs = with_parts(manifest.select("file_name", F.posexplode(terms).alias("query_id", "query_term")), parts).join(texts.withColumnRenamed("file_name", "part_name"), "part_name")
    rows = compress_both(jobs, o, "query_term", ("part_name", "query_id", "query_term"))
    like = lambda c: dot(embed(F.col("query_term")), embed(F.col(c + ".compressed_text"))) if embed else F.lit(None).cast("double")
    return rows.select(
        F.col("part_name").alias("File Name"), F.col("query_term").alias("Query Term"), F.col("by_length.compressed_text").alias("Compressed by Length"), F.col("by_topn.compressed_text").alias("Compressed by TopN"),
        like("by_length").alias("Similarity by Length"), like("by_topn").alias("Similarity by TopN"), F.col("by_length.compression_ratio").alias("Compression Ratio by Length"), F.col("by_topn.compression_ratio").alias("Compression Ratio by TopN"),
    )
