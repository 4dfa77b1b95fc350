"""The queries of the operators over the given tables, with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread
from . import decontam, lmscore, media, packing, shared, sharding, simhash, suffix, tokens, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sniffed(media.media_of_pages(_read(spark, sf_dir, "pages")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(_read(spark, sf_dir, "pages"), shared.scratch(spark, "warc"), True)
    return warc.pages_of(warc.read_warc(spark, files))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_read(spark, sf_dir, "documents"), shared.scratch(spark, "store"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(_read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    "op2_media": op2_media,
    "op3_warc": op3_warc,
    "op6_sharding": op6_sharding,
    "op4_lm_scores": op4_lm_scores,
    "op1_token_counts": op1_token_counts,
    "op5_packing": op5_packing,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op9_simhash": op9_simhash,
}

ORACLE_SQL: dict[str, str] = {
    # pages written as WARC files, with copies of records in payloads, must come back as they were
    "op3_warc": "SELECT page_id, url, html FROM pages",
    # whatever is merged on the way, the store holds the rows that arrived
    "op6_sharding": "SELECT doc_id, text, lang, source, n_chars FROM documents",
}
