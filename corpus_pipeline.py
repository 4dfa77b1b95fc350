"""A corpus from raw documents to packed training bins: five stages, each written as Parquet and read again by the next.

Every stage takes nulls in any column, empty and very long texts, equal rows, an empty table and other columns of any name. But for
the last, the columns of a stage's result are those of docs, and rows that it has no reason to drop stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gistline.llm import decontam, packing, shared, simhash, suffix, toxicity


def _other(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, rejects go. Null and empty texts are scored as texts without a word; without
    labels, or with one class of them, nothing is known to be toxic unless all labelled documents are."""
    return toxicity.drop_toxic(docs, _other(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of lowest doc_id (of one doc_id, of lowest text hash) stays; of rows equal in doc_id
    and text one. Null texts and those without a word are near to nothing."""
    return simhash.drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that also stand earlier in the corpus are cut out, and n_chars is counted anew; a document of which no word is
    left goes. Null, empty and shorter texts stay as they are."""
    return suffix.cut_repeats(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go. Null and empty texts hold none; null and too short items are in none."""
    return decontam.drop_contaminated(docs, _other(spark, sf_dir, "benchmark"))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in bins of 2048 words. Null texts and those without a word have none; equal rows are each packed."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_copies), ("suffix_dedup", repeats), ("decontamination", leaks), ("packing", bins)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage reads, and what it made on the way, is removed once its result has been written."""
    docs, before = _other(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        since = shared.mark(spark)
        uri = shared.scratch(spark, f"stage-{name}")
        docs = shared.table(stage(spark, docs, sf_dir), name, uri)
        shared.release(spark, since, keep=(uri,))
        if before:
            shared.remove(spark, before)
        before = uri
    return docs


#: Trained trees, fingerprints and suffix arrays are beyond SQL: the tests hold the stages against brute-force versions.
ORACLE_SQL = None
