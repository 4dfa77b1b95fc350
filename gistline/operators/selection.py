"""Choosing chunks by score, as column expressions over array<struct<idx, score, chunk>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PICKED = "array<struct<idx:int,chunk:string>>"


def ranked(scored: Column) -> Column:
    """By descending score, then ascending idx."""
    key = F.transform(scored, lambda c: F.struct((-c["score"]).alias("neg"), c["idx"].cast("int").alias("idx"), c["chunk"].alias("chunk")))
    return F.transform(F.array_sort(key), lambda c: F.struct(c["idx"].alias("idx"), c["chunk"].alias("chunk")))


def top(scored: Column, n: int) -> Column:
    return F.slice(ranked(scored), 1, n)


def _budget(scored: Column, most: int, skip: bool) -> Column:
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast(_PICKED).alias("picked"))

    def take(s, c):
        fits = s["open"] & (s["used"] + F.length(c["chunk"]) <= most)
        used = s["used"] + F.when(fits, F.length(c["chunk"])).otherwise(0)
        return F.struct(used.alias("used"), (F.lit(True) if skip else fits).alias("open"), F.when(fits, F.concat(s["picked"], F.array(c))).otherwise(s["picked"]).alias("picked"))

    return F.aggregate(ranked(scored), start, take, lambda s: s["picked"])


def until_full(scored: Column, most: int) -> Column:
    """In rank order while they fit into `most` characters together; the first that doesn't ends it."""
    return _budget(scored, most, False)


def while_fitting(scored: Column, most: int) -> Column:
    """In rank order, each that still fits into `most` characters."""
    return _budget(scored, most, True)


def either(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def in_order(picked: Column) -> Column:
    """array<string>: the chunks in the document's order."""
    return F.transform(F.array_sort(picked), lambda c: c["chunk"])
