"""Running totals over a whole table in key order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import drop, table


def running_total(df: DataFrame, key: str, value: str, name: str, buckets: int | None = None) -> DataFrame:
    """df with the total of value over all rows up to this one by key, a unique number (a null comes first).

    df is computed once, and its rows cut into `buckets` ranges of key of about as many rows (by default, as many as shuffles have
    partitions), however keys are spread; totals of the ranges before, one row each, are added to the total within.
    """
    once = table(df, "totalled")
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table(once.repartitionByRange(n, F.asc_nulls_first(key)).withColumn("__b", F.spark_partition_id()), "ranges")
    drop(once)
    before = ranged.groupBy("__b").agg(F.sum(value).alias("s")).withColumn("__before", F.coalesce(F.sum("s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    within = F.sum(value).over(Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__within", within).join(F.broadcast(before), "__b").withColumn(name, F.col("__within") + F.col("__before")).drop("__b", "__within", "__before")
