"""Row generators that evaluate their input once.

A plain ``explode`` makes Catalyst infer a filter on the array and push it towards the scan, which repeats the
expression behind the array (and, through a chain of projections, multiplies it). Outer generators do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list[str], array: Column | str, value: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias("_pos", value)).filter("_pos IS NOT NULL").drop("_pos")


def numbered(df: DataFrame, keep: list[str], array: Column | str, pos: str, value: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def settled(df: DataFrame) -> DataFrame:
    """The same rows as a generator's output, so that later filters test finished values."""
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
