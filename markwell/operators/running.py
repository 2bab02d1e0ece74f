"""Running totals and last values that never put one whole key into a single task.

A plain window partitioned by key would sort a hot key in one task. Here rows are dealt out by ranges of (key, position) that hold
about equally many rows, whatever the positions look like. Each range is scanned alone, and what earlier ranges hold of a
key is added from one row per range. Only a key that goes on from one range to the next needs that, and between two ranges
there is at most one such key: so these rows are at most twice as many as ranges, and are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwell.session import cut_lineage


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    dealt = df.repartitionByRange(*[F.col(k) for k in (*keys, *order)])
    return cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))


def _going_on(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows per key and range of keys that lie in more than one range."""
    of_key = Window.partitionBy(*keys)
    spans = parts.withColumn("_spans", F.min("_range").over(of_key) < F.max("_range").over(of_key))
    return spans.filter("_spans").drop("_spans")


def _with_earlier(local: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """Add what earlier ranges hold; null keys match each other."""
    renamed = earlier.withColumnsRenamed({c: f"_e_{c}" for c in (*keys, "_range")})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in (*keys, "_range")])
    return local.join(F.broadcast(renamed), same, "left")


def running_sums(df: DataFrame, keys: list[str], position: str, sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums of ``sums`` over ``position`` (unique per key)."""
    ranged = _ranged(df, keys, [position])
    inside = Window.partitionBy(*keys, "_range").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = _going_on(totals, keys).select(*keys, "_range", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums])
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    joined = _with_earlier(local, earlier, keys)
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in sums])


def last_values(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the last non-null ``value`` at or before each row in ``order`` (unique per key)."""
    ranged = _ranged(df, keys, order)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = ranged.groupBy(*keys, "_range").agg(F.max_by(value, held).alias("_end"))
    earlier = _going_on(ends, keys).select(*keys, "_range", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    local = ranged.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
    return _with_earlier(local, earlier, keys).select(*df.columns, F.coalesce("_here", "_before").alias(name))
