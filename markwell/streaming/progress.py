"""Streams of progress events: latest stage, timeline, durations, status machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from markwell import constants as K
from markwell.operators.running import running_sums

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("completed", "error")


def table_stream(spark: SparkSession, folder: str, file_name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream the Parquet files of ``folder`` that match ``file_name``, or those below it where a folder has that name."""
    # a plain name is written as a pattern too, as the source takes a path that is none for a folder
    path = f"{folder}/{file_name}" if any(c in file_name for c in "*?[{") else f"{folder}/{{{file_name}}}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stage_effects(progress: DataFrame, stages: tuple[str, ...] = K.STAGES) -> DataFrame:
    """A completed stage also completes the stages before it: at most ``len(stages)`` rows per event."""
    upto: Column = F.array("stage")
    for i, stage in enumerate(stages):
        earlier = F.array(*[F.lit(s) for s in stages[: i + 1]])
        upto = F.when((F.col("stage") == stage) & (F.col("status") == "completed"), earlier).otherwise(upto)
    return progress.withColumn("stage", F.explode(upto))


def latest_stage(progress: DataFrame, stages: tuple[str, ...] = K.STAGES) -> DataFrame:
    """Latest status per (doc_id, stage); the same plan serves batch and stream (update mode)."""
    return stage_effects(progress, stages).groupBy("doc_id", "stage").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq")
    )


def dedup_uploads(uploads: DataFrame, delay: str) -> DataFrame:
    """Drop re-uploads by hash; state is kept for ``delay`` only."""
    return uploads.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["file_hash"])


def timeline(rows: DataFrame, delay: str) -> DataFrame:
    """Rows per day; in append mode a day appears once the watermark has passed it."""
    windows = rows.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day")).agg(F.count("*").alias("n"))
    return windows.select(F.to_date("window.start").alias("day"), "n")


def processing_time(progress: DataFrame) -> DataFrame:
    """(doc_id, run, start_seq, end_seq, status, seconds): each start with the first end before the next start.

    A run number is a running count of starts over buckets of ``seq``, so a document with very many events is
    spread over tasks.
    """
    start = F.col("stage") == "upload"
    runs = running_sums(progress, ["doc_id"], "seq", {"run": start.cast("int")}).filter("run > 0")
    end = F.when(F.col("status").isin(*TERMINAL), F.struct("seq", "ts", "status"))
    grouped = runs.groupBy("doc_id", "run").agg(
        F.min(F.when(F.col("stage") == "upload", F.struct("seq", "ts"))).alias("s"), F.min(end).alias("e")
    )
    seconds = F.timestamp_diff("MILLISECOND", F.col("s.ts"), F.col("e.ts")) / 1000.0
    return grouped.filter("e IS NOT NULL").select(
        "doc_id", "run", F.col("s.seq").alias("start_seq"), F.col("e.seq").alias("end_seq"), F.col("e.status").alias("status"),
        seconds.alias("seconds"),
    )


def stream_processing_time(starts: DataFrame, ends: DataFrame, delay: str, longest_seconds: int) -> DataFrame:
    """Stream-stream interval join of starts and ends of one document, with a watermark on each side.

    (doc_id, start_seq, start_ts, end_seq, end_ts, status): every start with every end within ``longest_seconds``, as soon as both are
    there, and a row without end once the watermark has passed the last time an end could come. Spans of that length take part
    in the join key, a start in its own and the next one, so a document with very many events is spread over tasks and its state
    goes span by span. ``settle_runs`` picks the end of each start.
    """
    def span(ts: str) -> Column:
        return F.floor(F.unix_seconds(ts) / longest_seconds)

    s = starts.select("doc_id", F.col("seq").alias("start_seq"), F.col("ts").alias("start_ts")).withWatermark("start_ts", delay)
    e = ends.select(
        F.col("doc_id").alias("end_doc"), F.col("seq").alias("end_seq"), F.col("ts").alias("end_ts"), "status"
    ).withWatermark("end_ts", delay)
    s = s.withColumn("span", F.explode(F.array(span("start_ts"), span("start_ts") + 1)))
    e = e.withColumn("end_span", span("end_ts"))
    within = (
        (F.col("doc_id") == F.col("end_doc")) & (F.col("span") == F.col("end_span")) & (F.col("end_ts") >= F.col("start_ts"))
        & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {longest_seconds} SECONDS"))
    )
    return s.join(e, within, "left_outer").select("doc_id", "start_seq", "start_ts", "end_seq", "end_ts", "status")


def settle_runs(pairs: DataFrame) -> DataFrame:
    """(doc_id, start_seq, end_seq, status, seconds) from the rows of ``stream_processing_time``.

    An end belongs to the last start before it, and a start ends with the first end that is its own; a start without one (given up
    for a later start, or never ended in time) has NULL. Both are minima and maxima, so rows that a replay repeats do no harm.
    """
    owned = pairs.filter("end_seq IS NOT NULL").groupBy("doc_id", "end_seq").agg(
        F.max(F.struct("start_seq", "start_ts")).alias("s"), F.any_value("end_ts").alias("end_ts"), F.any_value("status").alias("status")
    )
    ended = owned.groupBy("doc_id", F.col("s.start_seq").alias("start_seq")).agg(
        F.min(F.struct("end_seq", "status", (F.unix_millis("end_ts") - F.unix_millis("s.start_ts")).alias("ms"))).alias("e")
    )
    known = pairs.select("doc_id", "start_seq").distinct().join(ended, ["doc_id", "start_seq"], "left")
    return known.select("doc_id", "start_seq", "e.end_seq", "e.status", (F.col("e.ms") / 1000.0).alias("seconds"))


class StatusMachine(StatefulProcessor):
    """pending -> processing -> completed or error; steps back and repeated states are ignored."""

    ORDER = {"pending": 0, "processing": 1, "completed": 2, "error": 2}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.current.get()[0] if self.current.exists() else "pending"
        # only the first row per state can cause a step, so a long group shrinks batch by batch
        first: dict[str, int] = {}
        for pdf in rows:
            for status, seq in pdf.groupby("status")["seq"].min().items():
                first[status] = min(seq, first.get(status, seq))
        steps = []
        for status, seq in sorted(first.items(), key=lambda item: item[1]):
            if self.ORDER.get(status, -1) > self.ORDER[state]:
                steps.append((key[0], state, status, seq))
                state = status
        self.current.update((state,))
        yield pd.DataFrame(steps, columns=["doc_id", "old_status", "new_status", "seq"])

    def close(self) -> None:
        pass


def status_transitions(progress: DataFrame) -> DataFrame:
    """(doc_id, old_status, new_status, seq) as a stateful stream."""
    status = F.when(F.col("status") == "in_progress", "processing").otherwise(F.col("status"))
    slim = progress.select("doc_id", status.alias("status"), "seq")
    return slim.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=StatusMachine(),
        outputStructType="doc_id bigint, old_status string, new_status string, seq bigint",
        outputMode="Append",
        timeMode="None",
    )
