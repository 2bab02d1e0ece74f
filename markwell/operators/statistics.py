"""Counts, histograms and timelines. Each is one partial aggregation over a few columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score bins by lower bound.
SCORE_BINS = ("0-2", "2-4", "4-6", "6-8", "8-10")


def status_class() -> Column:
    return (
        F.when(F.col("processing_status") == "error", "blocked")
        .when(F.col("approved") == 1, "approved")
        .otherwise("unread")
    )


def score_bin(score: Column) -> Column:
    return (
        F.when(score < 2, "0-2").when(score < 4, "2-4").when(score < 6, "4-6").when(score < 8, "6-8")
        .when(score.isNotNull(), "8-10")
    )


def status_counts(submissions: DataFrame) -> DataFrame:
    kinds = ("unread", "approved", "blocked")
    return submissions.agg(*[F.count_if(status_class() == k).alias(k) for k in kinds])


def score_histogram(submissions: DataFrame) -> DataFrame:
    """Five bins, empty ones included: five counters in one pass, then unpivoted."""
    bins = submissions.agg(*[F.count_if(score_bin(F.col("average_score")) == b).alias(b) for b in SCORE_BINS])
    return bins.select(
        F.inline_outer(F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"`{b}`").alias("n")) for b in SCORE_BINS]))
    )


def daily_timeline(rows: DataFrame, timestamp: str = "created_at") -> DataFrame:
    """Rows per day in order; values that are no timestamp are skipped."""
    day = F.to_date(F.col(timestamp).try_cast("timestamp"))
    return rows.select(day.alias("day")).filter("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n")).orderBy("day")


def statistics(submissions: DataFrame) -> DataFrame:
    """Status, score and day counts from a single scan: (section, label, n)."""
    slim = submissions.select(
        status_class().alias("status"), score_bin(F.col("average_score")).alias("bin"),
        F.date_format(F.to_date("created_at"), "yyyy-MM-dd").alias("day"),
    )
    grouped = slim.groupingSets([["status"], ["bin"], ["day"]], "status", "bin", "day").agg(
        F.count("*").alias("n"), F.grouping_id().alias("g")
    )
    counted = grouped.select(
        F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "score").otherwise("day").alias("section"),
        F.when(F.col("g") == 3, F.col("status")).when(F.col("g") == 5, F.col("bin")).otherwise(F.col("day")).alias("label"),
        "n",
    )
    return counted.filter("label IS NOT NULL")


def outcome_counts(results: DataFrame, group: str) -> DataFrame:
    """Successes and errors per group; the error list is a separate table, not a growing array."""
    return results.groupBy(group).agg(
        F.count_if(F.col("success")).alias("success_count"), F.count_if(~F.col("success")).alias("error_count")
    )


def outcome_errors(results: DataFrame, group: str) -> DataFrame:
    return results.filter(~F.col("success")).select(group, "doc_id", "error")


def share_with_total(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    """Count and percentage of each class; the total is summed over the few classes."""
    from pyspark.sql import Window

    counts = df.groupBy(label.alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))
