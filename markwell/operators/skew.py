"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 1000


def skew_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", heavy: int = HEAVY_KEYS) -> DataFrame:
    """Join ``rows`` with ``facts`` (a bounded number of rows per key) on ``key``.

    The ``heavy`` most frequent keys of ``rows`` are found by a map-side combined count and a top-k. Their facts
    are broadcast (at most ``heavy`` keys), so their rows never move. Every other key holds at most 1/heavy of
    the rows, and an ordinary shuffled join takes those. Nothing is dropped or sampled.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = F.broadcast(counts.orderBy(F.desc("_n"), key).limit(heavy).select(key))
    hot_part = rows.join(hot, key, "left_semi").join(F.broadcast(facts.join(hot, key, "left_semi")), key, how)
    cold_part = rows.join(hot, key, "left_anti").join(facts.join(hot, key, "left_anti"), key, how)
    return hot_part.unionByName(cold_part)
