"""Tables out: CSV exports and the action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from markwell import constants as K
from markwell.functions import text as T
from markwell.operators.reports import fixed, percent

LONG_LIMIT = 5000
LOG_JSON_LIMIT = 200


def export_wide(documents: DataFrame, packed: DataFrame) -> DataFrame:
    """One row per submission, also without answers; empty answers are left out first, so later answers move up."""
    given = F.filter(F.array(*[F.col(f"task_{k}") for k in K.TASKS]), lambda t: F.coalesce(F.length(t), F.lit(0)) > 0)
    joined = documents.join(packed, "doc_id", "left").withColumn("_given", given)
    slots = [T.collapse_truncate(F.get("_given", F.lit(k - 1))).alias(f"task_{k}") for k in K.TASKS]
    return joined.select(
        "full_filename", T.file_stem("full_filename").alias("filename"), "type", *slots, T.collapse_truncate("content").alias("content")
    )


def export_long(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per non-empty answer, cut at 5000 characters."""
    given = answers.filter(F.length("content") > 0).select("doc_id", "task_number", F.col("content").alias("_c"))
    return documents.join(given, "doc_id").select(
        F.col("full_filename").alias("filename"), F.col("type").alias("file_type"), F.col("created_at").alias("parsed_at"),
        "task_number", T.collapse_truncate("_c", LONG_LIMIT).alias("task_content"),
    )


def export_full(df: DataFrame) -> DataFrame:
    """All columns as text; nested values as JSON."""
    def flat(field: ST.StructField) -> Column:
        nested = isinstance(field.dataType, (ST.StructType, ST.ArrayType, ST.MapType))
        return (F.to_json(field.name) if nested else F.col(field.name).cast("string")).alias(field.name)

    return df.select(*[flat(f) for f in df.schema.fields])


def export_summary(rows: DataFrame) -> DataFrame:
    """Formatted columns, '-' when missing.

    ``rows``: full_filename, tasks_count, sim_1..3, score_1..3, average, logic, originality, max_similarity, likelihood.
    """
    def whole(c: Column, suffix: str = "") -> Column:
        return F.coalesce(F.concat(F.floor(c + 0.5).cast("string"), F.lit(suffix)), F.lit("-"))

    def share(c: Column) -> Column:
        return F.coalesce(percent(c), F.lit("-"))

    per_task = [
        c
        for k in (1, 2, 3)
        for c in (share(F.col(f"sim_{k}")).alias(f"similarity_{k}"), whole(F.col(f"score_{k}")).alias(f"score_{k}"))
    ]
    return rows.select(
        F.col("full_filename").alias("filename"), "tasks_count", *per_task,
        F.coalesce(fixed(F.round("average", 1), 1), F.lit("-")).alias("average"),
        whole(F.col("logic"), "%").alias("logic"), whole(F.col("originality"), "%").alias("originality"),
        share(F.col("max_similarity")).alias("max_similarity"), share(F.col("likelihood")).alias("likelihood"),
    )


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with header; with ``bom`` the first header name carries the byte order mark."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    out.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def render_action(ts: Column, action: Column, doc_id: Column, user: Column, details: Column, status: Column) -> Column:
    """One log line; ``details`` is a map of text values, JSON values cut at 200 characters."""
    def pair(e):
        is_json = e["value"].rlike(r"^[\[{]")
        cut = F.concat(F.left(e["value"], F.lit(LOG_JSON_LIMIT)), F.lit("..."))
        long_json = is_json & (F.length(e["value"]) > LOG_JSON_LIMIT)
        return F.concat(e["key"], F.lit("="), F.when(long_json, cut).otherwise(e["value"]))

    text = F.array_join(F.transform(F.map_entries(details), pair), ", ")
    return F.concat_ws(
        " | ",
        F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("]")),
        F.concat(F.lit("Action: "), action),
        F.concat(F.lit("Doc ID: "), doc_id.cast("string")),
        F.when(F.length(user) > 0, F.concat(F.lit("User: "), user)),
        F.when(F.length(text) > 0, F.concat(F.lit("Details: "), text)),
        F.concat(F.lit("Status: "), status),
    )


def parse_action(line: Column) -> Column:
    def part(label: str) -> Column:
        found = F.regexp_extract(line, rf" \| {label}: (.*?)(?: \| (?:Doc ID|User|Details|Status): |$)", 1)
        return F.when(F.length(found) > 0, found)

    return F.struct(
        F.to_timestamp(F.regexp_extract(line, r"^\[([^\]]*)\]", 1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        part("Action").alias("action"), part("Doc ID").cast("bigint").alias("doc_id"), part("User").alias("user"),
        part("Details").alias("details"), part("Status").alias("status"),
    )


def append_actions(lines: DataFrame, path: str) -> None:
    """Append (day, line) to the log, one folder per day."""
    lines.select("line", "day").write.mode("append").partitionBy("day").text(path)


def read_actions(spark, path: str) -> DataFrame:
    raw = spark.read.text(path)
    return raw.select("day", parse_action(F.col("value")).alias("a")).select("day", "a.*")
