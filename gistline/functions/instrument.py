"""How often functions ran and how long: one row a call, summed up by a grouped aggregate."""

from __future__ import annotations

import functools
import logging
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS: list[tuple[str, datetime, float]] = []


def timed(f):
    """Records each call of f, also those that raise."""

    @functools.wraps(f)
    def run(*a, **k):
        t = time.perf_counter()
        try:
            return f(*a, **k)
        finally:
            CALLS.append((f.__name__, datetime.now(timezone.utc), time.perf_counter() - t))

    return run


def calls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CALLS, "func string, at timestamp, seconds double")


def usage(rows: DataFrame, func: str = "func", at: str = "at", seconds: str = "seconds") -> DataFrame:
    """func, count, total_time, mean_time, max_time, last_used."""
    return rows.groupBy(F.col(func).alias("func")).agg(F.count("*").alias("count"), F.sum(seconds).alias("total_time"), F.avg(seconds).alias("mean_time"), F.max(seconds).alias("max_time"), F.max(at).alias("last_used"))


def log_to(folder: str, name: str = "gistline", screen: bool = True) -> logging.Logger:
    """A logger that appends to a file of the day."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    for h in [logging.FileHandler(Path(folder) / f"{datetime.now():%Y-%m-%d}.log", encoding="utf-8"), *([logging.StreamHandler()] if screen else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log
