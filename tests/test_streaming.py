import json

import pytest
from pyspark.sql import functions as F

from markwell.catalogues import INTERVIEW
from markwell.operators import similarity
from markwell.plans.streaming_queries import stream_ingest_dedup
from markwell.streaming import pipeline as L
from markwell.streaming import progress as S
from markwell.streaming.store import HEADS, DocumentStore


def progress(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, stage string, status string, seq long")
    return df.withColumn("ts", F.timestamp_seconds("seq"))


def stream_of(spark, df, folder, files=2):
    df.repartition(files).write.parquet(folder)
    return S.table_stream(spark, folder, "*.parquet", files_per_trigger=1)


ROWS = [
    (1, "upload", "in_progress", 1), (1, "parsing", "in_progress", 2), (1, "completed", "completed", 3),
    (1, "upload", "in_progress", 5), (1, "parsing", "error", 9), (2, "upload", "in_progress", 4), (2, "parsing", "error", 6),
    (2, "completed", "completed", 8), (3, "parsing", "in_progress", 7),
]


def test_latest_stage_stream_equals_batch(spark, tmp_path):
    df = progress(spark, ROWS)
    L.write_updates(S.latest_stage(stream_of(spark, df, str(tmp_path / "in"))), str(tmp_path / "c"), str(tmp_path / "out"))
    changes = spark.read.parquet(str(tmp_path / "out"))
    last = changes.groupBy("doc_id", "stage").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    assert set(last.collect()) == set(S.latest_stage(df).collect())
    got = {(r.doc_id, r.stage): r.status for r in last.collect()}
    assert got[1, "parsing"] == "error" and got[2, "parsing"] == "completed" and got[1, "cleaning"] == "completed"


def test_processing_time(spark):
    rows = S.processing_time(progress(spark, ROWS)).orderBy("doc_id", "run").collect()
    assert [(r.doc_id, r.run, r.status, r.seconds) for r in rows] == [(1, 1, "completed", 2.0), (1, 2, "error", 4.0), (2, 1, "error", 2.0)]


def test_processing_time_stream(spark, tmp_path):
    """Two files: a run that ends in a later batch, one given up for a later start, one that never ends; equal to the batch form."""
    first = progress(spark, [*ROWS, (4, "upload", "in_progress", 10), (5, "upload", "in_progress", 11), (5, "upload", "in_progress", 12)])
    later = progress(spark, [(4, "scoring", "error", 40), (5, "completed", "completed", 41), (6, "upload", "in_progress", 8000), (6, "completed", "completed", 9000)])
    folder = str(tmp_path / "in")
    for part in (first, later):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = S.table_stream(spark, folder, "*.parquet", files_per_trigger=1)
    joined = S.stream_processing_time(stream.filter("stage = 'upload'"), stream.filter("status IN ('completed', 'error')"), "1 minute", 100)
    L.write_available(joined, str(tmp_path / "c"), str(tmp_path / "out"))
    got = {(r.doc_id, r.start_seq): (r.end_seq, r.status, r.seconds) for r in S.settle_runs(spark.read.parquet(str(tmp_path / "out"))).collect()}
    batch = S.processing_time(first.unionByName(later)).filter("seconds <= 100")
    closed = {(r.doc_id, r.start_seq): (r.end_seq, r.status, r.seconds) for r in batch.collect()}
    assert {k: v for k, v in got.items() if v[0] is not None} == closed
    assert got[4, 10] == (40, "error", 30.0) and got[5, 11] == (None, None, None) and (6, 8000) not in got


def test_status_machine(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    L.write_available(
        S.status_transitions(stream_of(spark, progress(spark, ROWS), str(tmp_path / "in"), 1)), str(tmp_path / "c"), str(tmp_path / "out")
    )
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "pending", "processing", 1), (1, "processing", "completed", 3), (2, "pending", "processing", 4),
                   (2, "processing", "error", 6), (3, "pending", "processing", 7)}


def test_table_stream_of_file_and_folder(spark, tmp_path):
    """A table is one file or a folder of files; both stand beside other tables."""
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 40).alias("text"))
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    rows.toPandas().to_parquet(str(tmp_path / "file.parquet"))
    (tmp_path / "single").mkdir()
    (tmp_path / "file.parquet").rename(tmp_path / "single" / "documents.parquet")
    for name in ("folder", "single"):
        spark.range(3).write.parquet(str(tmp_path / name / "events.parquet"))
        out = stream_ingest_dedup(spark, str(tmp_path / name))
        assert out.count() == 40 and {r.file_hash for r in out.collect()} == {
            r.h for r in rows.select(F.sha2("text", 256).alias("h")).distinct().collect()
        }


KEYS = [("hr", t, f"primary key of table {t}") for t in range(1, 5)] + [("ai", t, f"answer {t} names the primary key") for t in range(1, 5)]


def rules(spark):
    keys = spark.createDataFrame(KEYS, "kind string, task_number int, content string")
    return L.Assessment(INTERVIEW, keys, "2024-06-01")


def submit(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps(dict(zip(("doc_id", "filename", "content"), r, strict=True)), ensure_ascii=False) for r in rows]
    (folder / name).write_text("\n".join(lines))


def test_pipeline_takes_the_latest_version_of_a_document(spark, tmp_path):
    """Several submissions a file, one document in two batches, a blank one, a replayed batch, and a restart without new data."""
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    submit(inbox, "a.json", [(1, "a.txt", "Вопрос 1. old\nВопрос 2. б"), (2, "b.txt", " \n"), (3, "c.txt", "Вопрос 1. primary key\nВопрос 4. d")])
    flow = L.SubmissionPipeline(spark, out, rules(spark))
    flow.run(L.submission_stream(spark, str(inbox)), str(tmp_path / "c"))
    submit(inbox, "b.json", [(1, "a2.txt", "Вопрос 1. primary key of table 1\nВопрос 2. б\nВопрос 3. в"), (4, None, "Вопрос 2. г")])
    flow.run(L.submission_stream(spark, str(inbox)), str(tmp_path / "c"))
    again = L.SubmissionPipeline(spark, out, rules(spark))
    again.run(L.submission_stream(spark, str(inbox)), str(tmp_path / "c"))
    again.process(spark.createDataFrame([(9, "x", "Вопрос 1. never")], L.SUBMISSION_SCHEMA), 1)
    assert again.store.batches() == [0, 1]
    documents = {r.doc_id: r for r in again.store.current("documents").collect()}
    assert {i: r.status for i, r in documents.items()} == {1: "completed", 2: "error", 3: "completed", 4: "completed"}
    assert documents[1].filename == "a2.txt" and documents[2].message == "Empty file"
    scores = {r.doc_id: r for r in again.scores().collect()}
    assert {i: r.tasks_count for i, r in scores.items()} == {1: 3, 3: 2, 4: 1}
    assert scores[1].task_1_score > 1 and scores[4].task_1_score is None and scores[3].task_4_logic_score is not None
    assert scores[1].other_id in (3, 4) and scores[1].task_4_originality_score is None
    reports = {r.doc_id: r.report for r in again.store.current("reports").collect()}
    assert sorted(reports) == [1, 3, 4] and "a2.txt" in reports[1]
    # a document that comes again without text leaves the tables and the lists of others
    again.process(spark.createDataFrame([(3, "c.txt", "")], L.SUBMISSION_SCHEMA), 2)
    scores = {r.doc_id: r for r in again.scores().collect()}
    assert sorted(scores) == [1, 4] and scores[1].other_id == 4 and again.similar.top().count() == 2
    # the state equals that of a run over the latest texts alone
    whole = L.SubmissionPipeline(spark, str(tmp_path / "whole"), rules(spark))
    whole.process(again.store.current("documents").select("doc_id", "filename", "content"), 0)
    assert set(map(tuple, whole.scores().collect())) == {tuple(r) for r in scores.values()}


def test_store_versions(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "doc_id long, x string")

    def make(df):
        def staged(n):
            return {"facts": store.stage(n, "facts", df), HEADS: store.stage(n, HEADS, df.select("doc_id").distinct())}
        return staged

    def facts():
        return sorted(map(tuple, store.current("facts").collect()))

    store = DocumentStore(spark, str(tmp_path / "s"))
    assert store.version() is None and store.current("facts") is None and store.manifest() == []
    assert store.write(0, make(rows((1, "a"), (1, "b"), (2, "c"))))
    # staged but never committed: nobody sees it, and the batch that runs again replaces it
    store.stage(1, "facts", rows((2, "lost"), (7, "lost")))
    assert facts() == [(1, "a"), (1, "b"), (2, "c")]
    assert store.write(1, make(rows((1, "new"))))
    assert not store.write(1, make(rows((1, "replayed"))))
    assert facts() == [(1, "new"), (2, "c")]
    # a document that a later batch names without rows has none
    store.commit(2, {"facts": store.stage(2, "facts", rows((5, "e"))),
                     HEADS: store.stage(2, HEADS, rows((2, ""), (5, "")).select("doc_id"))})
    assert facts() == [(1, "new"), (5, "e")]
    store.compact()
    assert facts() == [(1, "new"), (5, "e")] and store.batches() == [2] and store.is_committed(0)
    store.write(3, make(rows((5, "later"), (6, "f"))))
    assert facts() == [(1, "new"), (5, "later"), (6, "f")]
    store.vacuum()
    assert facts() == [(1, "new"), (5, "later"), (6, "f")] and not (tmp_path / "s/facts/batch_id=0").exists()
    store.compact()
    store.vacuum()
    assert facts() == [(1, "new"), (5, "later"), (6, "f")] and len(store.manifest()) == 2
    with pytest.raises(ValueError):
        store.commit(9, {"facts": rows((1, "a"))})


def test_similarity_table_equals_full_run(spark, tmp_path):
    rows = [(d, s, [float((d * 7 + s * 3 + i * i) % 11) - 5.0 for i in range(4)]) for d in range(12) for s in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, slot int, vec array<double>")
    df.repartition(3, "doc_id").write.parquet(str(tmp_path / "in"))
    stream = S.table_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_trigger=1)
    table = L.SimilarityTable(spark, str(tmp_path / "t"))
    got = table.run(stream, str(tmp_path / "c")).select("doc_id", "place", "other_id", F.round("overall_similarity", 9).alias("s"))
    want = similarity.top_similar(df).select("doc_id", "place", "other_id", F.round("overall_similarity", 9).alias("s"))
    assert set(got.select("doc_id", "place", "s").collect()) == set(want.select("doc_id", "place", "s").collect())
    # a restart without new data, and a replay, leave the state as it is
    again = L.SimilarityTable(spark, str(tmp_path / "t"))
    again.advance(df.limit(5), 2)
    assert again.run(stream, str(tmp_path / "c")).count() == 36 and again.codes.batches() == [0, 1, 2]


def test_failed_batch_starts_over(spark, tmp_path):
    """Lists are committed before codes: a batch that stops between them computes nothing twice into the state."""
    rows = [(d, s, [float((d * 7 + s * 3 + i * i) % 11) - 5.0 for i in range(4)]) for d in range(9) for s in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, slot int, vec array<double>")
    table = L.SimilarityTable(spark, str(tmp_path / "t"))
    table.advance(df.filter("doc_id < 6"), 0)
    commit, table.codes.commit = table.codes.commit, None
    with pytest.raises(TypeError):
        table.advance(df.filter("doc_id >= 6"), 1)
    table.codes.commit = commit
    table.advance(df.filter("doc_id >= 6"), 1)
    key = ["doc_id", "place", F.round("overall_similarity", 9).alias("s"), "total_comparisons"]
    assert set(table.top().select(*key).collect()) == set(similarity.top_similar(df).select(*key).collect())
