"""The engine's operators as queries over the given tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .functions import text as T
from .functions.chunking import each, with_chunks
from .functions.instrument import usage
from .functions.stopwords import ENGLISH
from .operators import selection, terms
from .operators.running import running_total
from .plans.compress import DEDICATED, Options, assembled, batch, compress, compress_both, scored
from .sources.files import tokens_without, with_parts
from .sources.tables import spread

SMALL, FULL = 20, 150  # chunk lengths: many chunks, and the production setting
KEY = ["doc_id"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir) -> DataFrame:
    return spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def _asked(spark, sf_dir) -> DataFrame:
    """Each document with a benchmark item's text as its query."""
    items = _read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    size = items.agg(F.count("*").alias("items"))
    return _docs(spark, sf_dir).crossJoin(F.broadcast(size)).join(items, F.pmod("doc_id", "items") == F.col("item_id")).select("doc_id", "text", "query")


CUT = Options("bm25", topn=5, chunk_length=SMALL).cut


def _rows(scored_: DataFrame) -> DataFrame:
    return scored_.select("doc_id", F.explode(each("scored")).alias("c")).select("doc_id", F.col("c.idx").alias("chunk_idx"), F.round("c.score", 6).alias("score"))


def sentence_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences("text")).alias("idx", "sentence"))


def segment_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.segments("text", 100)).alias("idx", "segment"))


def comma_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.comma_pieces("text")).alias("idx", "piece"))


def space_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.space_pieces("text", 80)).alias("idx", "piece"))


def custom_length(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.weighted_length("text").alias("weighted_length"))


def pdf_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_pdf("text").alias("cleaned"))


def chunk_pack(spark, sf_dir):
    return with_chunks(_docs(spark, sf_dir), most=SMALL).select("doc_id", F.posexplode(each("chunks")).alias("chunk_idx", "chunk"))


def chunk_pack_full(spark, sf_dir):
    return with_chunks(_docs(spark, sf_dir), most=FULL).select("doc_id", F.posexplode(each("chunks")).alias("chunk_idx", "chunk"))


def chunk_counts(spark, sf_dir):
    counts = with_chunks(_docs(spark, sf_dir), most=SMALL).select("doc_id", F.size("chunks").cast("long").alias("n_chunks"))
    return running_total(counts, "doc_id", "n_chunks", "cumulative")


def tokenize_en(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.tokens("text")).alias("pos", "token"))


def stopword_anti(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ENGLISH], "token string")
    all_ = _docs(spark, sf_dir).select(F.explode(T.tokens("text", (), 0)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens_without(all_, words)


def query_split(spark, sf_dir):
    q = F.concat(F.lit("  "), F.replace("text", F.lit("."), F.lit("? ")), F.lit("?"))
    return _read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.query_terms(q)).alias("idx", "term"))


def part_files(spark, sf_dir):
    return with_parts(_docs(spark, sf_dir).select("doc_id", F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("file_name"))).select("doc_id", "part", "part_name")


def detect_language(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.language("text").alias("detected"))


def random_excerpt(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.excerpt("text", 200, "doc_id").alias("excerpt"))


def highlight_html(spark, sf_dir):
    return with_chunks(_docs(spark, sf_dir), most=FULL).select("doc_id", T.highlighted("chunks").alias("html"))


def term_frequency(spark, sf_dir):
    return terms.chunk_terms(_docs(spark, sf_dir), KEY, CUT)


def document_frequency(spark, sf_dir):
    return terms.document_terms(_docs(spark, sf_dir), KEY, CUT)


def chunk_length_mean(spark, sf_dir):
    return terms.chunk_lengths(_docs(spark, sf_dir), KEY, CUT).withColumn("avg_tokens", F.round("avg_tokens", 6))


def vocabulary(spark, sf_dir):
    return terms.vocabulary(_docs(spark, sf_dir), KEY, CUT)


def query_overlap(spark, sf_dir):
    """Distinct tokens that a chunk shares with its document's query."""
    return terms.query_overlap(_asked(spark, sf_dir), KEY, CUT, "query")


def bm25_query(spark, sf_dir):
    return _rows(scored(_asked(spark, sf_dir), Options("bm25", topn=5, chunk_length=SMALL), "query", texts=False))


def bm25_noquery(spark, sf_dir):
    return _rows(scored(_docs(spark, sf_dir), Options("bm25", topn=5, chunk_length=SMALL), texts=False))


def tfidf_query(spark, sf_dir):
    return _rows(scored(_asked(spark, sf_dir), Options("tfidf", topn=5, chunk_length=SMALL), "query", texts=False))


def tfidf_noquery(spark, sf_dir):
    return _rows(scored(_docs(spark, sf_dir), Options("tfidf", topn=5, chunk_length=SMALL), texts=False))


def _selected(pick):
    def run(spark, sf_dir):
        d = scored(_docs(spark, sf_dir), Options("bm25", topn=5, chunk_length=SMALL))
        return d.select("doc_id", F.explode(pick(F.col("scored"))).alias("c")).select("doc_id", F.col("c.idx").alias("chunk_idx"))

    return run


select_topn = _selected(lambda s: selection.top(s, 3))
select_stop = _selected(lambda s: selection.until_full(s, 900))
select_skip = _selected(lambda s: selection.while_fitting(s, 900))
select_both = _selected(lambda s: selection.either(selection.while_fitting(s, 900), selection.top(s, 3)))


def _compressed(d: DataFrame) -> DataFrame:
    return d.select("doc_id", "compressed_text", F.round("compression_ratio", 6).alias("compression_ratio"), F.size("selected_chunks").alias("n_selected"))


def compress_bm25(spark, sf_dir):
    return _compressed(compress(_asked(spark, sf_dir), Options("bm25", topn=5), "query"))


def compress_tfidf(spark, sf_dir):
    return _compressed(compress(_asked(spark, sf_dir), Options("tfidf", max_length=2048), "query"))


def compress_both_ways(spark, sf_dir):
    d = compress_both(_docs(spark, sf_dir), Options("bm25", max_length=2048, topn=5))
    return d.select("doc_id", F.col("by_length.compressed_text").alias("by_length"), F.col("by_topn.compressed_text").alias("by_topn"))


def cooc_edges(spark, sf_dir):
    return terms.cooccurrence(_docs(spark, sf_dir), KEY, cut=CUT).withColumn("weight", F.round("weight", 9))


def position_weights_first(spark, sf_dir):
    return terms.first_position_weights(_docs(spark, sf_dir), KEY, cut=CUT).withColumn("weight", F.round("weight", 9))


def position_weights_each(spark, sf_dir):
    return terms.each_position_weights(_docs(spark, sf_dir), KEY, cut=CUT).withColumn("weight", F.round("weight", 9))


def tfidf_mean(spark, sf_dir):
    return terms.mean_tfidf(_docs(spark, sf_dir), KEY, CUT).withColumn("weight", F.round("weight", 9))


def pagerank_fixed(spark, sf_dir):
    return terms.cooccurrence_ranks(_docs(spark, sf_dir), KEY, cut=CUT).withColumn("rank", F.round("rank", 8))


def _ranked(method):
    def run(spark, sf_dir):
        return _rows(scored(_asked(spark, sf_dir), Options(method, topn=5, chunk_length=SMALL), "query", texts=False))

    return run


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@F.arrow_udf(ArrayType(DoubleType()))
def letters(texts: pa.Array) -> pa.Array:
    """A vector of a text without a model: how often each letter occurs."""
    low = [(t or "").lower() for t in texts.to_pylist()]
    counts = np.array([[float(t.count(x)) for x in LETTERS] for t in low]).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * len(LETTERS)), pa.array(counts))


def query_similarity(spark, sf_dir):
    """The batch job for every document and its query: both selections, and how like the query each is."""
    d = _asked(spark, sf_dir).withColumnRenamed("query", "asked")
    parts = d.select(F.concat(F.lit("doc"), "doc_id", F.lit("_part1.txt")).alias("file_name"), "text")
    manifest = d.select(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("file_name"), F.col("asked").alias("query"))
    b = batch(manifest, parts, Options("bm25", max_length=2048, topn=5), embed=letters, parts=1)
    return b.select(
        F.regexp_extract("File Name", r"doc(-?\d+)_", 1).cast("long").alias("doc_id"), F.col("Query Term").alias("query"), F.col("Similarity by Length").alias("by_length"), F.col("Similarity by TopN").alias("by_topn"),
        F.round("Compression Ratio by Length", 6).alias("ratio_by_length"), F.round("Compression Ratio by TopN", 6).alias("ratio_by_topn"),
    )


def embedding_dot(spark, sf_dir):
    """Each vector with the next by vec_id."""
    return _neighbours(spark, sf_dir).select("vec_id", F.round(T.dot("embedding", "other"), 4).alias("dot"))


def embedding_cosine(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("vec_id", F.round(T.cosine("embedding", "other"), 4).alias("cosine"))


def _neighbours(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


def function_usage(spark, sf_dir):
    u = usage(_read(spark, sf_dir, "events"), "event_type", "ts", "value")
    return u.withColumns({c: F.round(c, 4) for c in ("total_time", "mean_time", "max_time")})


QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, segment_split, comma_split, space_split, custom_length, pdf_clean, chunk_pack, chunk_pack_full, chunk_counts, tokenize_en, stopword_anti, query_split, part_files, detect_language, random_excerpt, highlight_html,
        term_frequency, document_frequency, chunk_length_mean, vocabulary, query_overlap, bm25_query, bm25_noquery, tfidf_query, tfidf_noquery, compress_bm25, compress_tfidf, compress_both_ways,
        cooc_edges, position_weights_first, position_weights_each, tfidf_mean, pagerank_fixed, query_similarity, embedding_dot, embedding_cosine, function_usage,
    )
} | {
    "select_topn": select_topn, "select_stop": select_stop, "select_skip": select_skip, "select_both": select_both,
    "combined_ff": _ranked("textrank"), "combined_tf": _ranked("singlerank"), "combined_ft": _ranked("positionrank"), "combined_tt": _ranked("pos+tfidfrank"),
    **{name.removeprefix("dedicated_"): _ranked(name) for name in DEDICATED},
}
