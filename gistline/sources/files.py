"""Manifests, texts in any encoding, their parts, settings, results."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

PARTS = 10


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file_name, query from a CSV file with a header; blanks at the ends of a query are kept."""
    return spark.read.schema("file_name string, query string").option("header", True).option("ignoreLeadingWhiteSpace", False).option("escape", '"').csv(path)


def with_parts(files: DataFrame, parts: int = PARTS) -> DataFrame:
    """files (file_name) with part and part_name: name_part1.ext and on."""
    stem, end = F.regexp_extract("file_name", r"^(.*?)(\.[^./]+)?$", 1), F.regexp_extract("file_name", r"^(.*?)(\.[^./]+)?$", 2)
    return files.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts)))).withColumn("part_name", F.concat(stem, F.lit("_part"), F.col("part").cast("string"), end))


def decode(raw: bytes) -> tuple[str, str]:
    """The encoding found and the text; what can't be decoded is left out."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return name, raw.decode(name, "ignore")
    for name in ("utf-8", "gb18030"):
        try:
            return name, raw.decode(name)
        except UnicodeDecodeError:
            continue
    return "utf-8", raw.decode("utf-8", "ignore")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name, encoding, text of the files at a path or glob, each whole."""

    ship(spark)

    @F.pandas_udf("encoding string, text string")
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(bytes(r)) for r in raw], columns=["encoding", "text"])

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), run("content").alias("t")).select("file_name", "t.*")


def stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """One a line, stripped, without empties; of a size for an expression (checked)."""
    words = spark.read.text(path).select(F.trim("value").alias("w")).filter("w <> ''").distinct().limit(100_001).toPandas().w
    if len(words) > 100_000:
        raise ValueError("too many stopwords for an expression; use tokens_without()")
    return tuple(sorted(words))


def tokens_without(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """tokens (token, ...) whose token is not in words (token): an anti-join, for lists of any size."""
    return tokens.join(words.select("token").distinct(), "token", "left_anti").select(*tokens.columns)


@dataclass(frozen=True)
class Settings:
    compressor_type: str = "bm25"
    language: str = "en"
    use_query: bool = True
    token_length_zh: int = 128
    token_length_en: int = 150
    topN: int = 5
    compressed_length: int = 512
    window_size: int = 50
    use_tfidf: bool = True
    use_position: bool = True

    def options(self, **more):
        from ..plans.compress import METHODS, Options

        method = self.compressor_type if self.compressor_type in METHODS else "combined"
        length = self.token_length_zh if self.language == "zh" else self.token_length_en
        return Options(method, **{"max_length": self.compressed_length, "topn": self.topN, "chunk_length": length, "window": self.window_size, "use_tfidf": self.use_tfidf, "use_position": self.use_position} | more)


def settings(path: str) -> Settings:
    """From a YAML file; keys of its `graph` section count as top-level ones, unknown ones are an error but for edge_type."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    flat = {k: v for k, v in raw.items() if k != "graph"} | {k: v for k, v in (raw.get("graph") or {}).items() if k != "edge_type"}
    return Settings(**flat)


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines, a file for each partition."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_results(df: DataFrame, path: str) -> None:
    """One JSON array of one-record arrays, indented, for other tools; rows stream through the driver one partition at a time."""
    import json

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("w", encoding="utf-8") as sink:
        sink.write("[")
        for i, row in enumerate(df.toLocalIterator()):
            sink.write((",\n" if i else "\n") + json.dumps([row.asDict(True)], ensure_ascii=False, indent=4))
        sink.write("\n]\n")


def write_html(df: DataFrame, path: str, column: str = "html") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
