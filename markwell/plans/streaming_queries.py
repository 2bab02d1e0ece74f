"""Streams over the given tables, run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwell.plans import fixtures as X
from markwell.plans.catalog import query, with_views
from markwell.plans.report_queries import ORGANIZER_SQL, TIME
from markwell.plans.vector_queries import PAIRS, SCORES, TOP_SQL, rounded
from markwell.plans.views import ORACLE_VIEWS, key_set_of, v_keys, v_marked, v_progress, v_vectors
from markwell.session import cut_lineage
from markwell.sources.files import scratch_dir
from markwell.streaming import pipeline as L
from markwell.streaming import progress as S

BOARD = ("upload", "parsing", "scoring", "completed")


def progress_stream(spark, sf):
    kind = F.col("event_type")
    return S.table_stream(spark, sf, "events.parquet").select(
        F.col("user_id").alias("doc_id"),
        F.when(kind == "view", "upload").when(kind == "click", "parsing").when(kind == "signup", "scoring")
        .when(kind == "purchase", "completed").otherwise("error").alias("stage"),
        F.when(kind == "error", "error").when(kind == "purchase", "completed").otherwise("in_progress").alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


@query("stream_latest_stage", "T1", """
SELECT doc_id, stage, arg_max(status, seq) AS status, max(seq) AS seq FROM (
  SELECT doc_id, stage, status, seq FROM v_progress UNION ALL
  SELECT doc_id, s, 'completed', seq FROM v_progress, (VALUES ('upload'), ('parsing'), ('scoring')) q(s) WHERE stage = 'completed') GROUP BY 1, 2""", ("v_progress",))
def stream_latest_stage(spark, sf):
    out = scratch_dir(spark)
    L.write_updates(S.latest_stage(progress_stream(spark, sf), BOARD), f"{out}/checkpoint", f"{out}/updates")
    changes = spark.read.parquet(f"{out}/updates")
    return changes.groupBy("doc_id", "stage").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


@query("stream_ingest_dedup", "T2", "SELECT DISTINCT sha256(text) AS file_hash FROM documents")
def stream_ingest_dedup(spark, sf):
    out = scratch_dir(spark)
    uploads = S.table_stream(spark, sf, "documents.parquet").select(
        F.sha2("text", 256).alias("file_hash"), F.timestamp_seconds("doc_id").alias("created_at")
    )
    L.write_available(S.dedup_uploads(uploads, "3650 days"), f"{out}/checkpoint", f"{out}/rows")
    return spark.read.parquet(f"{out}/rows").select("file_hash")


@query("stream_timeline", "T3", """
SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_timeline(spark, sf):
    """Closed days only: the last day stays open until the watermark passes it."""
    out = scratch_dir(spark)
    rows = S.table_stream(spark, sf, "events.parquet").select(F.col("ts").cast("timestamp").alias("created_at"))
    L.write_available(S.timeline(rows, "1 hour"), f"{out}/checkpoint", f"{out}/days")
    return spark.read.parquet(f"{out}/days")


@query("processing_time", "T4", """
WITH r AS (SELECT *, count(*) FILTER (stage = 'upload') OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM v_progress),
e AS (SELECT doc_id, run, min(seq) FILTER (stage = 'upload') AS start_seq, min(seq) FILTER (status IN ('completed', 'error')) AS end_seq FROM r WHERE run > 0 GROUP BY ALL)
SELECT e.doc_id, e.run, e.start_seq, e.end_seq, t.status, round(date_diff('millisecond', date_trunc('millisecond', s.ts), date_trunc('millisecond', t.ts)) / 1000.0, 1) AS seconds
FROM e JOIN v_progress s ON s.seq = e.start_seq JOIN v_progress t ON t.seq = e.end_seq""", ("v_progress",))
def processing_time(spark, sf):
    progress = v_progress(spark, sf).withColumn("ts", F.date_trunc("millisecond", "ts"))
    return S.processing_time(progress).withColumn("seconds", F.round("seconds", 1))


@query("stream_processing_time", "T4", """
WITH r AS (SELECT *, count(*) FILTER (stage = 'upload') OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM v_progress),
e AS (SELECT doc_id, run, min(seq) FILTER (stage = 'upload') AS start_seq, min(seq) FILTER (status IN ('completed', 'error')) AS end_seq FROM r WHERE run > 0 GROUP BY ALL),
wm AS (SELECT least(max(ts) FILTER (stage = 'upload'), max(ts) FILTER (status IN ('completed', 'error'))) - INTERVAL 1 HOUR AS wm FROM v_progress),
j AS (SELECT e.*, s.ts AS start_ts, t.ts AS end_ts, t.status, EXISTS (SELECT 1 FROM v_progress x WHERE x.doc_id = e.doc_id AND x.status IN ('completed', 'error')
        AND x.ts >= s.ts AND x.ts <= s.ts + INTERVAL 36 HOUR) AS paired
      FROM e JOIN v_progress s ON s.seq = e.start_seq LEFT JOIN v_progress t ON t.seq = e.end_seq AND t.ts <= s.ts + INTERVAL 36 HOUR)
SELECT doc_id, start_seq, CASE WHEN end_ts IS NOT NULL THEN end_seq END AS end_seq, status, date_diff('millisecond', date_trunc('millisecond', start_ts), date_trunc('millisecond', end_ts)) / 1000.0 AS seconds
FROM j, wm WHERE paired OR start_ts + INTERVAL 36 HOUR < wm""", ("v_progress",))
def stream_processing_time(spark, sf):
    """Events arrive in four files, one per batch; runs that do not end within 36 hours come out without an end."""
    out = scratch_dir(spark)
    progress = v_progress(spark, sf)
    events = progress.select(F.max("seq") + 1).scalar()
    for k in range(4):
        part = progress.filter(F.floor(F.col("seq") * 4 / events) == k)
        part.coalesce(1).write.mode("append").parquet(f"{out}/inbox")
    stream = S.table_stream(spark, f"{out}/inbox", "*.parquet", files_per_trigger=1).withColumn("ts", F.col("ts").cast("timestamp"))
    runs = S.stream_processing_time(stream.filter("stage = 'upload'"), stream.filter("status IN ('completed', 'error')"), "1 hour", 36 * 3600)
    L.write_available(runs, f"{out}/checkpoint", f"{out}/pairs")
    return S.settle_runs(spark.read.parquet(f"{out}/pairs"))


# The answers as segmented and cleaned take the place of the raw ones in all views behind them.
ASSESSED = ("v_cleaned", "v_answers", "v_hashed", "v_keys", "v_hashed_keys", "v_catalogue", "v_criteria", "v_eval")


def assessed(body: str) -> str:
    """An oracle whose ``v_answers`` are the cleaned answers; ``v_cleaned`` and ``v_marked`` stand for what they came from."""
    raw = with_views("SELECT doc_id, task_number, content, n_received FROM v_moved", ("v_answers", "v_hashed", "v_fragments", "v_tails", "v_moved"))
    marked = with_views("SELECT doc_id, content FROM v_marked", ("v_answers", "v_marked"))
    views = dict(ORACLE_VIEWS) | {
        "v_cleaned": raw, "v_marked": marked, "v_answers": "SELECT doc_id, task_number, content FROM v_cleaned WHERE content <> ''",
    }
    ctes = ",\n".join(f"{v} AS ({views[v].strip()})" for v in ("v_marked", *ASSESSED))
    return f"WITH {ctes},\n{body.strip()[5:]}"


@query("stream_pipeline", "T5", assessed(f"""
WITH {ORGANIZER_SQL},
whole AS (SELECT doc_id, list_transform(range(64), lambda i: CAST(len(list_filter(buckets, lambda b: b = i)) AS DOUBLE)) AS vec FROM (
  SELECT doc_id, list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim(content, <CHARS>)), '[^<WD><SP>]', ' ', 'g'), '[<SP>]+', ' ', 'g')), ' '), lambda t: t <> ''),
    lambda t: CAST(concat('0x', md5(t)[1:8]) AS BIGINT) % 64) AS buckets FROM v_marked)),
slots AS (SELECT doc_id, task_number AS slot, vec FROM v_hashed UNION ALL SELECT doc_id, 0, vec FROM whole),
pairs AS (SELECT a.doc_id, greatest(0, (coalesce(avg(sim) FILTER (a.slot > 0), 0) + coalesce(max(sim) FILTER (a.slot = 0), 0)) / 2) AS overall
  FROM slots a JOIN slots b ON a.slot = b.slot AND a.doc_id <> b.doc_id,
  LATERAL (SELECT list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)) AS sim) GROUP BY a.doc_id, b.doc_id),
counts AS (SELECT doc_id, CAST(count(*) FILTER (trim(content, <CHARS>) <> '') AS INT) AS tasks_count FROM v_cleaned GROUP BY 1)
SELECT c.doc_id, c.tasks_count, CASE c.tasks_count WHEN 2 THEN 'validated' WHEN 4 THEN 'cleaned' ELSE 'partial' END AS cleaning_status,
  round(avg(CASE WHEN e.task_number <= 3 THEN e.final_score END), 2) AS average_score_tasks_1_3, max(e.final_score) FILTER (e.task_number = 1) AS task_1_score,
  max(e.final_score) FILTER (e.task_number = 3) AS task_3_score, max(CASE WHEN e.chosen = 'hr' THEN e.hr_sim WHEN e.chosen = 'ai' THEN e.ai_sim END) FILTER (e.task_number = 2) AS task_2_similarity,
  any_value(r.recommended) AS recommended, any_value(md5(r.report)) AS report_md5, any_value(round(s.best, 6)) AS best_similarity
FROM counts c JOIN v_eval e ON e.doc_id = c.doc_id JOIN organizer r ON r.doc_id = c.doc_id JOIN (SELECT doc_id, max(overall) AS best FROM pairs GROUP BY 1) s ON s.doc_id = c.doc_id
GROUP BY c.doc_id, c.tasks_count"""))
def stream_pipeline(spark, sf):
    """Files of many submissions arrive in batches. A third of the documents comes first with the text of another document and
    then again with its own; one file holds blank submissions. The last batch is replayed. All that counts is each document's latest text."""
    out = scratch_dir(spark)
    named = v_marked(spark, sf).select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("filename"), "content")
    marked = cut_lineage(named)
    early = marked.filter("doc_id % 3 = 0").withColumn("content", F.concat(F.lit("Вопрос 1. early\n"), "content"))
    blank = marked.filter("doc_id % 50 = 1").select((-F.col("doc_id") - 1).alias("doc_id"), "filename", F.lit(" \n").alias("content"))
    rules = L.Assessment(X.CATALOGUE, v_keys(spark, sf), TIME, key_set_of(spark, sf))
    flow = L.SubmissionPipeline(spark, f"{out}/tables", rules)
    for rows in (early.unionByName(marked.filter("doc_id % 3 = 1")).unionByName(blank), marked.filter("doc_id % 3 <> 1")):
        rows.coalesce(2).write.mode("append").json(f"{out}/inbox")
        flow.run(L.submission_stream(spark, f"{out}/inbox"), f"{out}/checkpoint")
    flow.process(marked.limit(0), flow.store.version())
    scores, text = flow.scores(), flow.store.current("reports")
    return scores.join(text, "doc_id").select(
        "doc_id", "tasks_count", "cleaning_status", "average_score_tasks_1_3", "task_1_score", "task_3_score", "task_2_similarity",
        "recommended", F.md5("report").alias("report_md5"), F.round("overall_similarity", 6).alias("best_similarity"),
    )


@query("stream_similarity_update", "T6", TOP_SQL, PAIRS)
def stream_similarity_update(spark, sf):
    """Vectors arrive in two batches, and the stream is restarted without new data; the lists equal those of a full run."""
    out = scratch_dir(spark)
    v_vectors(spark, sf).repartition(2, "doc_id").write.parquet(f"{out}/inbox")
    stream = S.table_stream(spark, f"{out}/inbox", "*.parquet", files_per_trigger=1)
    L.SimilarityTable(spark, f"{out}/tables").run(stream, f"{out}/checkpoint")
    top = L.SimilarityTable(spark, f"{out}/tables").run(stream, f"{out}/checkpoint")
    return rounded(top, *SCORES).select("doc_id", "place", "other_id", *SCORES, "total_comparisons")


@query("stream_status_machine", "T7", """
WITH f AS (SELECT doc_id, min(seq) FILTER (status = 'in_progress') AS p, min(seq) FILTER (status <> 'in_progress') AS t FROM v_progress GROUP BY 1)
SELECT doc_id, 'pending' AS old_status, 'processing' AS new_status, p AS seq FROM f WHERE p < t OR t IS NULL
UNION ALL SELECT f.doc_id, CASE WHEN p < t THEN 'processing' ELSE 'pending' END, v.status, t FROM f JOIN v_progress v ON v.seq = f.t""", ("v_progress",))
def stream_status_machine(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    out = scratch_dir(spark)
    L.write_available(S.status_transitions(progress_stream(spark, sf)), f"{out}/checkpoint", f"{out}/steps")
    return spark.read.parquet(f"{out}/steps")
