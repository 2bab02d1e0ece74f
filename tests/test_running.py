"""Running sums and last values over count-balanced ranges, against plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from markwell.operators import running as R
from markwell.operators.segmentation import assign_images


def table(spark):
    rng = random.Random(4)
    rows = [(None if k == 5 else k % 4, rng.randrange(10**15), rng.choice([None, 1, 2, 3])) for k in (rng.randrange(9) for _ in range(3000))]
    return spark.createDataFrame(rows, "key long, pos long, x int").dropDuplicates(["key", "pos"])


def test_running_sums_equal_a_window(spark):
    df = table(spark)
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("n", F.sum(F.lit(1)).over(w)).withColumn("s", F.sum(F.coalesce("x", F.lit(0))).over(w))
    got = R.running_sums(df, ["key"], "pos", {"n": F.lit(1), "s": F.coalesce("x", F.lit(0))})
    assert set(map(tuple, got.collect())) == set(map(tuple, want.collect()))
    assert R.running_sums(df.limit(0), ["key"], "pos", {"n": F.lit(1)}).count() == 0


def test_last_values_equal_a_window(spark):
    df = table(spark)
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("last", F.last("x", ignorenulls=True).over(w))
    assert set(map(tuple, R.last_values(df, ["key"], ["pos"], "x", "last").collect())) == set(map(tuple, want.collect()))


def test_hot_key_of_sparse_ids_is_spread(spark):
    """A million rows of one key, 2^32 apart: no range holds much more than its share."""
    df = spark.range(1_000_000).select(F.lit(1).alias("key"), (F.col("id") * 2**32).alias("pos"))
    sizes = [r["count"] for r in R._ranged(df, ["key"], ["pos"]).groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1.5 * 1_000_000 / len(sizes)
    sums = R.running_sums(df, ["key"], "pos", {"n": F.lit(1)})
    assert sums.filter(F.col("n") != F.col("pos") / 2**32 + 1).count() == 0


def test_images_on_boundaries(spark):
    markers = spark.createDataFrame([(1, 2, 10), (1, 1, 5), (1, 3, 10), (2, 4, 7), (1, 1, 8)], "doc_id long, task_number int, start int")
    images = [(1, 4), (1, 5), (1, 6), (1, 10), (1, 11), (1, 11), (2, 7), (2, 8), (3, 1), (1, None), (None, 3)]
    df = spark.createDataFrame([(d, p, "i", 9) for d, p in images], "doc_id long, position int, path string, _x int")
    got = sorted(((r.doc_id, r.position, r.task_number) for r in assign_images(df, markers).collect()), key=str)
    want = [(1, 4, None), (1, 5, 1), (1, 6, 1), (1, 10, 1), (1, 11, 3), (1, 11, 3), (2, 7, 4), (2, 8, 4), (3, 1, None), (1, None, None), (None, 3, None)]
    assert got == sorted(want, key=str)
