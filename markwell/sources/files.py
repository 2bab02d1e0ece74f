"""Files in: submissions, reference answers, task prompts, CSV imports."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions import text as T
from markwell.functions.registry import DECODERS, Registry
from markwell.functions.text import bind


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder the cluster names; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return os.path.join(shared, f"markwell-{uuid.uuid4().hex}")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raise ValueError("set spark.checkpoint.dir to a shared folder")


def scan_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, type, size, content) of accepted files up to the upload limit.

    The size test reaches the listing (``binaryFile`` filters on length), so oversized files are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace(F.col("path"), "^.*/", "")
    return (
        files.filter(F.col("length") <= K.MAX_UPLOAD_BYTES)
        .select("path", name.alias("filename"), T.file_extension(name).alias("type"), F.col("length").alias("size"), "content")
        .filter(F.col("type").isin(*K.ACCEPTED_TYPES))
    )


def decode_files(files: DataFrame, decoders: Registry = DECODERS) -> DataFrame:
    """Replace the bytes by text with the decoder of the type; files without one get an error row."""
    text: Column = F.lit(None).cast("string")
    for name in decoders.names():
        text = F.when(F.col("type") == name, decoders.get(name)(F.col("content"))).otherwise(text)
    known = F.col("type").isin(*decoders.names())
    return files.withColumn(
        "error", F.when(~known, F.concat(F.lit("Unsupported file type: "), "type"))
    ).withColumn("content", text)


REFERENCE_MARKER = rf"(?iu)ответ[{K.SPACE_CLASS}]+(\d+)\."


def cut_reference_answers(texts: DataFrame, id_col: str = "source_id", text_col: str = "content") -> DataFrame:
    """(id, task_number, content) of texts with "Ответ N." headings; the last of equal numbers wins."""
    hits = T.match_starts(text_col, REFERENCE_MARKER)
    number = r"CAST(regexp_extract(m.hit, r'(\d+)', 1) AS int)"
    end = f"coalesce(get(ms, i + 1).pos, length({text_col}))"
    begin = "m.pos + length(m.hit)"
    body = f"btrim(substr({text_col}, {begin} + 1, {end} - ({begin})), '{K.SPACE_CHARS}')"
    parts = F.expr(
        bind(hits, "ms", f"transform(ms, (m, i) -> named_struct('i', i, 'task_number', {number}, 'content', {body}))")
    )
    rows = texts.select(id_col, F.inline_outer(parts)).filter("task_number IS NOT NULL")
    return rows.groupBy(id_col, "task_number").agg(F.max_by("content", "i").alias("content"))


def read_reference_answers(spark: SparkSession, path: str) -> DataFrame:
    """One text file; a missing file gives no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as exc:  # the analysis error of a missing path
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], "task_number int, content string")
    return cut_reference_answers(raw.select(F.lit(0).alias("source_id"), F.col("value").alias("content"))).drop("source_id")


def read_task_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(task_number, prompt) from the first data row of a CSV with columns task_1..task_4."""
    first = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8").limit(1)
    present = [k for k in K.TASKS if f"task_{k}" in first.columns]
    slots = F.array(
        *[F.struct(F.lit(k).alias("task_number"), F.coalesce(F.col(f"task_{k}"), F.lit("")).alias("prompt")) for k in present]
    )
    return first.select(F.inline_outer(slots))


def read_submission_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)
