"""Winners, leaderboards and row states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwell.session import cut_lineage


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with their place: a distributed top-k, then a numbering of those n rows."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def is_blocked() -> Column:
    return F.col("processing_status") == "error"


def _rank_order() -> list[Column]:
    return [F.desc("average_score"), F.desc_nulls_last("created_at"), F.asc("doc_id")]


def winners(submissions: DataFrame, n: int) -> DataFrame:
    """The best ``n`` approved, unblocked, scored submissions."""
    if n < 1:
        raise ValueError("top_n must be at least 1")
    eligible = submissions.filter(~is_blocked() & (F.col("approved") == 1) & F.col("average_score").isNotNull())
    return top_n(eligible, _rank_order(), n)


def select_winners(submissions: DataFrame, n: int) -> DataFrame:
    """Set candidate_status of the winners; earlier winners keep their status."""
    chosen = F.broadcast(winners(submissions, n).select("doc_id", F.lit(True).alias("_won")))  # n rows
    return (
        submissions.join(chosen, "doc_id", "left")
        .withColumn("candidate_status", F.when(F.col("_won"), "winner").otherwise(F.col("candidate_status")))
        .drop("_won")
    )


def leaderboard_key() -> Column:
    """Approved first, then unapproved, blocked last; by score inside."""
    score = F.coalesce(F.col("average_score"), F.lit(0.0))
    return F.when(is_blocked(), score - 1_000_000).when(F.col("approved") == 1, score + 1_000_000).otherwise(score)


def leaderboard(submissions: DataFrame) -> DataFrame:
    """Number every row by (sort_key desc, newest first, doc_id).

    Rows are dealt out by ranges of the order and numbered inside their range; what earlier ranges hold is added from one
    count per range, so no task sorts the whole table, whatever the keys look like. Columns that the caller leaves out are
    not carried.
    """
    order = [F.desc("sort_key"), F.desc_nulls_last("created_at"), F.asc("doc_id")]
    keyed = submissions.withColumn("sort_key", leaderboard_key())
    ranged = cut_lineage(keyed.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.withColumn("_row", inside).join(F.broadcast(offsets), "_range")  # a row per range
    return ranked.select(*keyed.columns, (F.col("_offset") + F.col("_row")).cast("bigint").alias("place"))


def row_status(submissions: DataFrame, n: int) -> DataFrame:
    """blocked > winner > top_n_approved > read > unread."""
    approved = (F.col("approved") == 1) & (F.col("average_score") > 0)
    best = submissions.filter(approved).orderBy(*_rank_order()).limit(n).select("doc_id", F.lit(True).alias("_top"))
    return (
        submissions.join(F.broadcast(best), "doc_id", "left")
        .withColumn(
            "row_status",
            F.when(is_blocked(), "blocked")
            .when(F.col("candidate_status") == "winner", "winner")
            .when(approved & F.coalesce("_top", F.lit(False)), "top_n_approved")
            .when(approved, "read")
            .otherwise("unread"),
        )
        .drop("_top")
    )


def reset_competition(submissions: DataFrame) -> DataFrame:
    """Winners and recommended go back to read; ``was_reset`` marks the changed rows."""
    hit = F.coalesce(F.col("candidate_status").isin("winner", "recommended"), F.lit(False))
    return submissions.select(
        *[c for c in submissions.columns if c not in ("candidate_status", "messages_sent")],
        F.when(hit, "read").otherwise(F.col("candidate_status")).alias("candidate_status"),
        F.when(hit, 0).otherwise(F.col("messages_sent")).alias("messages_sent"),
        hit.alias("was_reset"),
    )


def mark_messages_sent(submissions: DataFrame) -> DataFrame:
    won = F.coalesce(F.col("candidate_status") == "winner", F.lit(False))
    return submissions.withColumn("messages_sent", F.when(won, 1).otherwise(F.col("messages_sent")))


def message_summary(submissions: DataFrame) -> DataFrame:
    """One row: winners, all_sent, and the error of an empty winner list."""
    won = F.coalesce(F.col("candidate_status") == "winner", F.lit(False))
    out = submissions.agg(
        F.count_if(won).alias("winners"),
        F.coalesce(F.bool_and(F.when(won, F.col("messages_sent") == 1)), F.lit(False)).alias("all_sent"),
    )
    return out.withColumn("error", F.when(F.col("winners") == 0, "No winners found"))


def task4_percent(originality: Column, logic: Column) -> Column:
    mean = F.coalesce((originality + logic) / 2, originality, logic)
    return F.coalesce(F.concat(F.floor(mean + 0.5).cast("string"), F.lit("%")), F.lit("-"))


def enough_approved(submissions: DataFrame, n: int) -> DataFrame:
    approved = F.count_if(~is_blocked() & (F.col("approved") == 1))
    return submissions.agg(approved.alias("approved")).select(
        "approved", F.lit(n).cast("bigint").alias("requested"), (F.col("approved") >= n).alias("enough")
    )
