"""Tables as they lie in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL_PER_CORE = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of under 2 MB a core, which may be one row group and so one task, over all cores; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_PER_CORE else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
