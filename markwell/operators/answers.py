"""Answers in long form (doc_id, task_number, content) and one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions import text as T


def slot_names(prefix: str = "task_") -> list[str]:
    return [f"{prefix}{k}" for k in K.TASKS]


def pack(answers: DataFrame) -> DataFrame:
    """(doc_id, task_1..task_4): conditional aggregates, combined map-side, so a row never outgrows four texts."""
    return answers.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("task_number") == k, F.col("content"))).alias(f"task_{k}") for k in K.TASKS]
    )


def unpack(packed: DataFrame, prefix: str = "task_") -> DataFrame:
    slots = F.array(
        *[F.struct(F.lit(k).alias("task_number"), F.col(f"{prefix}{k}").alias("content")) for k in K.TASKS]
    )
    return packed.select("doc_id", F.inline_outer(slots))


def non_empty_count(columns: list[Column]) -> Column:
    return sum(((~T.is_blank(c)).cast("int") for c in columns), F.lit(0))


def cleaning_status(tasks_count: Column) -> Column:
    return F.when(tasks_count == 2, "validated").when(tasks_count == 4, "cleaned").otherwise("partial")


def normalize_slots(found: DataFrame, position: str | None = None) -> DataFrame:
    """Exactly one row per document and task 1..4: the first non-empty content, else ''."""
    order = F.col(position) if position else F.col("content")
    first = [
        F.coalesce(
            F.min_by(
                T.strip("content"), F.when((F.col("task_number") == k) & ~T.is_blank("content"), order)
            ),
            F.lit(""),
        ).alias(f"task_{k}")
        for k in K.TASKS
    ]
    return unpack(found.groupBy("doc_id").agg(*first))


def pivot_tasks(answers: DataFrame) -> DataFrame:
    packed = pack(answers).select(
        "doc_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in slot_names()]
    )
    return packed.withColumn("tasks_count", non_empty_count([F.col(c) for c in slot_names()])).withColumn(
        "cleaning_status", cleaning_status(F.col("tasks_count"))
    )


def validate_task_count(answers: DataFrame) -> DataFrame:
    count = F.count_if(~T.is_blank("content")).cast("int")
    return answers.groupBy("doc_id").agg(count.alias("tasks_count")).withColumn(
        "cleaning_status", cleaning_status(F.col("tasks_count"))
    )
