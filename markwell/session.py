"""Session helpers: a tuned local/cluster session, checked broadcasts and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROW_LIMIT = 10_000


def get_session(app_name: str = "markwell", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``limit`` rows.

    The probe reads at most ``limit + 1`` rows. A larger side is returned unhinted, so Catalyst
    plans a shuffled join with AQE skew handling instead.
    """
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for expensive row-local work on an input of very few splits.

    A large input has far more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by ``key`` for expensive work per key: a few tasks per core, or as many as the input has splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(3 * cores, df.rdd.getNumPartitions()), key)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the cluster (a temporary one only in tests)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a shared folder before using iterative operators")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
