"""Life cycle, statistics, ranking and keyword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwell.operators import keywords as W
from markwell.operators import lifecycle as L
from markwell.operators import ranking as R
from markwell.operators import statistics as A
from markwell.plans.catalog import query
from markwell.plans.views import table, texts, v_answers, v_keys, v_submissions

SUBS = ("v_submissions",)


def labelled(spark, sf):
    """Ids of labelled documents with quality 1, used as a user's selection."""
    return table(spark, sf, "labels").filter("quality = 1").select("doc_id")


def with_states(spark, sf):
    """Submissions with impression, candidate status and message flag."""
    d = F.col("doc_id")
    return v_submissions(spark, sf).withColumns(
        {
            "overall_impression": F.when(d % 3 == 0, F.lit("  ")).when(d % 3 == 1, F.concat(F.lit("note "), d)),
            "candidate_status": F.when(d % 6 == 0, "winner").when(d % 6 == 1, "recommended").when(d % 6 == 2, "read").otherwise("unread"),
            "messages_sent": F.when(d % 12 == 0, 1).otherwise(0),
        }
    )


STATES_SQL = """(SELECT *, CASE doc_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN concat('note ', doc_id) END AS overall_impression,
  CASE doc_id % 6 WHEN 0 THEN 'winner' WHEN 1 THEN 'recommended' WHEN 2 THEN 'read' ELSE 'unread' END AS candidate_status,
  CASE WHEN doc_id % 12 = 0 THEN 1 ELSE 0 END AS messages_sent FROM v_submissions)"""


@query("route_by_type", "S3", """
SELECT doc_id, type, CASE WHEN type <> 'xls' THEN type END AS decoder, type <> 'xls' AS accepted,
       CASE WHEN type = 'xls' THEN 'Unsupported file type: xls' END AS error FROM v_submissions""", SUBS)
def route_by_type(spark, sf):
    return L.route_by_type(v_submissions(spark, sf)).select("doc_id", "type", "decoder", "accepted", "error")


@query("import_csv_new_only", "S9", """
SELECT full_filename, type, file_hash, 'completed' AS processing_status FROM v_submissions WHERE doc_id % 2 = 1""", SUBS)
def import_csv_new_only(spark, sf):
    subs = v_submissions(spark, sf).select("doc_id", "full_filename", "type", "file_hash")
    existing = subs.filter("doc_id % 2 = 0")
    out = L.import_new_only(existing, subs.unionByName(subs))
    return out.select("full_filename", "type", "file_hash", "processing_status")


@query("ingest_dedup", "L1", """
WITH stored AS (SELECT file_hash, min(doc_id) AS id, arg_min(full_filename, doc_id) AS name FROM v_submissions WHERE doc_id % 2 = 0 GROUP BY 1),
b AS (SELECT *, min(doc_id) OVER (PARTITION BY file_hash) AS first_id FROM v_submissions WHERE doc_id % 2 = 1)
SELECT b.doc_id, b.full_filename, CASE WHEN s.id IS NOT NULL OR b.doc_id <> first_id THEN 'duplicate' ELSE 'accepted' END AS outcome,
  CASE WHEN s.id IS NOT NULL THEN s.id WHEN b.doc_id <> first_id THEN first_id END AS existing_id,
  CASE WHEN s.id IS NOT NULL THEN s.name WHEN b.doc_id <> first_id THEN f.full_filename END AS existing_name
FROM b LEFT JOIN stored s ON s.file_hash = b.file_hash LEFT JOIN v_submissions f ON f.doc_id = b.first_id""", SUBS)
def ingest_dedup(spark, sf):
    """Even ids are stored, odd ids arrive: both halves of the whole table take part."""
    subs = v_submissions(spark, sf).select("doc_id", "full_filename", "file_hash")
    return L.ingest_dedup(subs.filter("doc_id % 2 = 0"), subs.filter("doc_id % 2 = 1")).drop("file_hash")


@query("upsert_documents", "L2", """
SELECT s.doc_id, s.filename, coalesce(CASE WHEN l.toxic = 0 THEN 'completed' WHEN l.doc_id % 2 = 0 THEN 'pending' END, s.processing_status) AS processing_status,
  coalesce(l.quality, s.approved) AS approved, CASE WHEN l.doc_id IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE s.created_at END AS updated_at
FROM v_submissions s LEFT JOIN labels l ON l.doc_id = s.doc_id""", SUBS)
def upsert_documents(spark, sf):
    base = v_submissions(spark, sf).select("doc_id", "filename", "processing_status", "approved", F.col("created_at").alias("updated_at"))
    labels = table(spark, sf, "labels")
    changes = labels.select(
        "doc_id", F.when(F.col("toxic") == 0, "completed").alias("processing_status"), F.col("quality").alias("approved"), F.lit(2).alias("seq")
    )
    # every other document was written before, with other values, and once more with nothing in it
    early = labels.filter("doc_id % 2 = 0").select(
        "doc_id", F.lit("pending").alias("processing_status"), (1 - F.col("quality")).alias("approved"), F.lit(1).alias("seq")
    )
    nothing = early.withColumns({"processing_status": F.lit(None).cast("string"), "approved": F.lit(None).cast("int"), "seq": F.lit(3)})
    unknown = changes.withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    whole = changes.unionByName(early).unionByName(nothing).unionByName(unknown)
    return L.upsert(base, whole, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"), order="seq")


@query("approve_gated", "L3", f"""
SELECT s.doc_id, CASE WHEN l.doc_id IS NOT NULL AND s.doc_id % 3 = 1 THEN 1 ELSE s.approved END AS approved,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN s.doc_id % 3 = 1 THEN 'approved' ELSE 'rejected' END AS approval
FROM {STATES_SQL} s LEFT JOIN labels l ON l.doc_id = s.doc_id AND l.quality = 1""", SUBS)
def approve_gated(spark, sf):
    return L.approve_gated(with_states(spark, sf), labelled(spark, sf)).select("doc_id", "approved", "approval")


@query("batch_set_status", "L4", """
SELECT a.action, count(*) FILTER (l.doc_id IS NOT NULL) AS changed_rows,
  sum(CASE WHEN l.doc_id IS NULL THEN s.approved WHEN a.action = 'approve' THEN 1 WHEN a.action = 'unapprove' THEN 0 ELSE s.approved END)::BIGINT AS approved_after,
  count(*) FILTER (CASE WHEN l.doc_id IS NULL THEN s.processing_status WHEN a.action = 'block' THEN 'error' WHEN a.action = 'unblock' THEN 'completed' ELSE s.processing_status END = 'error') AS blocked_after
FROM v_submissions s LEFT JOIN labels l ON l.doc_id = s.doc_id AND l.quality = 1, (VALUES ('approve'), ('unapprove'), ('block'), ('unblock')) a(action) GROUP BY 1""", SUBS)
def batch_set_status(spark, sf):
    subs, ids = v_submissions(spark, sf), labelled(spark, sf)
    out = None
    for action in L.BATCH_ACTIONS:
        one = L.batch_set_status(subs, ids, action).agg(
            F.count_if("changed").alias("changed_rows"), F.sum(F.col("approved").cast("bigint")).alias("approved_after"),
            F.count_if(F.col("processing_status") == "error").alias("blocked_after"),
        ).withColumn("action", F.lit(action))
        out = one if out is None else out.unionByName(one)
    return out


@query("batch_delete", "L5", """
SELECT doc_id, filename FROM v_submissions WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""", SUBS)
def batch_delete(spark, sf):
    return L.batch_delete(v_submissions(spark, sf).select("doc_id", "filename"), labelled(spark, sf))


@query("lookup_document", "L6", """
SELECT v.file_hash AS value, s.doc_id FROM (SELECT DISTINCT sha256(text) AS file_hash FROM documents UNION SELECT DISTINCT sha256(text) FROM benchmark) v
LEFT JOIN (SELECT file_hash, min(doc_id) AS doc_id FROM v_submissions GROUP BY 1) s ON s.file_hash = v.file_hash""", SUBS)
def lookup_document(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("value"))
    other = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("value"))
    return L.lookup_many(v_submissions(spark, sf), docs.unionByName(other), "file_hash")


@query("list_documents", "L7", """
SELECT doc_id, full_filename, created_at FROM v_submissions ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 20 OFFSET 10""", SUBS)
def list_documents(spark, sf):
    """A page of the newest submissions: the limit is the feature."""
    return L.list_documents(v_submissions(spark, sf).select("doc_id", "full_filename", "created_at"), limit=20, offset=10)


@query("reprocess_queue", "L8", """
SELECT doc_id, full_filename, processing_status, CASE WHEN doc_id % 9 = 0 THEN 'error' ELSE 'queued' END AS outcome,
       CASE WHEN doc_id % 9 = 0 THEN 'File hash or type is missing' END AS error FROM v_submissions WHERE processing_status IN ('pending', 'error')""", SUBS)
def reprocess_queue(spark, sf):
    subs = v_submissions(spark, sf)
    return L.reprocess_queue(subs.withColumn("file_hash", F.when(F.col("doc_id") % 9 != 0, F.col("file_hash"))))


@query("selection_state", "L9", """
SELECT count(*) AS selected, count(*) FILTER (approved = 1) AS approved, count(*) FILTER (approved <> 1) AS unapproved,
  count(*) FILTER (processing_status = 'error') AS blocked, count(*) FILTER (processing_status <> 'error') AS unblocked
FROM v_submissions WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""", SUBS)
def selection_state(spark, sf):
    return L.selection_state(v_submissions(spark, sf), labelled(spark, sf))


@query("add_missing_columns", "L10", """
SELECT doc_id, filename, CASE WHEN doc_id % 2 = 1 THEN approved END AS approved FROM v_submissions""", SUBS)
def add_missing_columns(spark, sf):
    subs = v_submissions(spark, sf)
    old = subs.filter("doc_id % 2 = 0").select("doc_id", "filename")
    return L.add_missing_columns(old, subs.filter("doc_id % 2 = 1").select("doc_id", "filename", "approved"))


@query("question_set_union", "L11", """
SELECT q AS task_number, q IN (SELECT CAST(turn AS INT) FROM conversations) AS in_candidate,
  q IN (SELECT task_number FROM v_keys WHERE kind = 'hr') AS in_hr, q IN (SELECT task_number + 2 FROM v_keys WHERE kind = 'ai') AS in_ai
FROM (SELECT DISTINCT CAST(turn AS INT) AS q FROM conversations UNION SELECT task_number FROM v_keys WHERE kind = 'hr' UNION SELECT task_number + 2 FROM v_keys WHERE kind = 'ai')""", ("v_keys",))
def question_set_union(spark, sf):
    candidate = table(spark, sf, "conversations").select(F.col("turn").cast("int").alias("task_number"))
    keys = v_keys(spark, sf)
    ai = keys.filter("kind = 'ai'").select((F.col("task_number") + 2).alias("task_number"))
    return L.question_set_union(candidate, keys.filter("kind = 'hr'"), ai)


@query("flatten_contest_config", "L12", """
SELECT page_id AS contest_id, t.n AS task_number, 1 AS criterion_number, url AS criterion_text, CASE WHEN page_id % 3 = 0 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
FROM pages, (VALUES (1), (2)) t(n) WHERE page_id % 10 NOT IN (0, 1, 2)""")
def flatten_contest_config(spark, sf):
    """Contest configurations made from the pages: some lack a name, a task text or have a bad task number."""
    p = F.col("page_id")
    criteria = F.array(
        F.struct(F.lit(1).alias("criterion_number"), F.col("url").alias("criterion_text"), F.when(p % 3 == 0, 2.5).alias("weight")),
        F.struct(F.lit(2).alias("criterion_number"), F.lit(" ").alias("criterion_text"), F.lit(1.0).alias("weight")),
    )
    task = F.struct(F.when(p % 10 != 1, F.col("url")).alias("task_text"), F.lit("").alias("reference_answer"), criteria.alias("criteria"))
    number = F.when(p % 10 == 2, "7").otherwise("2")
    config = F.struct(
        F.when(p % 10 != 0, F.col("url")).alias("name"), F.lit(1).alias("is_active"),
        F.create_map(F.lit("1"), task, number, task).alias("tasks"),
    )
    configs = table(spark, sf, "pages").select(p.alias("contest_id"), F.to_json(config).alias("config"))
    return L.contest_criteria(L.parse_contests(configs))


@query("status_counts", "A1", """
SELECT count(*) FILTER (processing_status <> 'error' AND approved = 0) AS unread, count(*) FILTER (processing_status <> 'error' AND approved = 1) AS approved,
       count(*) FILTER (processing_status = 'error') AS blocked FROM v_submissions""", SUBS)
def status_counts(spark, sf):
    return A.status_counts(v_submissions(spark, sf))


BIN_SQL = "CASE WHEN average_score < 2 THEN '0-2' WHEN average_score < 4 THEN '2-4' WHEN average_score < 6 THEN '4-6' WHEN average_score < 8 THEN '6-8' ELSE '8-10' END"


@query("score_histogram", "A2", f"""
SELECT b.bin, count(s.bin) AS n FROM (VALUES ('0-2'), ('2-4'), ('4-6'), ('6-8'), ('8-10')) b(bin)
LEFT JOIN (SELECT {BIN_SQL} AS bin FROM v_submissions) s ON s.bin = b.bin GROUP BY 1""", SUBS)
def score_histogram(spark, sf):
    return A.score_histogram(v_submissions(spark, sf))


@query("daily_timeline", "A3", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def daily_timeline(spark, sf):
    ts = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    return A.daily_timeline(table(spark, sf, "events").select(ts.alias("created_at")))


@query("statistics", "A4", f"""
SELECT 'status' AS section, CASE WHEN processing_status = 'error' THEN 'blocked' WHEN approved = 1 THEN 'approved' ELSE 'unread' END AS label, count(*) AS n FROM v_submissions GROUP BY ALL
UNION ALL SELECT 'score', {BIN_SQL}, count(*) FROM v_submissions GROUP BY ALL
UNION ALL SELECT 'day', strftime(created_at, '%Y-%m-%d'), count(*) FROM v_submissions WHERE created_at IS NOT NULL GROUP BY ALL""", SUBS)
def statistics(spark, sf):
    return A.statistics(v_submissions(spark, sf))


@query("outcome_counts", "A8", """
SELECT user_id, count(*) FILTER (event_type <> 'error') AS success_count, count(*) FILTER (event_type = 'error') AS error_count FROM events GROUP BY 1""")
def outcome_counts(spark, sf):
    results = table(spark, sf, "events").select("user_id", (F.col("event_type") != "error").alias("success"))
    return A.outcome_counts(results, "user_id")


@query("share_with_total", "A9", """
SELECT label, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS pct FROM (
  SELECT CASE WHEN processing_status = 'error' THEN 'blocked' WHEN approved = 1 THEN 'approved' ELSE 'unread' END AS label, count(*) AS n FROM v_submissions GROUP BY 1)""", SUBS)
def share_with_total(spark, sf):
    return A.share_with_total(v_submissions(spark, sf), A.status_class())


@query("keyword_frequency", "A5", """
WITH w AS (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '[<WD>]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[<WD>]+'), 1) AS pos FROM documents),
c AS (SELECT lang, word, count(*) AS n, min(doc_id * 100000000 + pos) AS seen FROM w WHERE length(word) > 2 AND NOT list_contains(<STOP>, word) GROUP BY ALL)
SELECT lang, place, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, seen) AS place FROM c) WHERE place <= 15""")
def keyword_frequency(spark, sf):
    """Top 15 words per language (a top-k report over all texts)."""
    return W.keyword_frequency(texts(spark, sf), ["lang"], "text", 15, "doc_id")


TFIDF_SQL = """
WITH t AS (SELECT k, list_filter(string_split(txt, ' '), lambda w: length(w) > 2 AND NOT list_contains(<STOP>, w)) AS tok
  FROM (SELECT {key} AS k, trim(regexp_replace(lower({text}), '[^<WD>]+', ' ', 'g')) AS txt FROM {source}) WHERE length(txt) >= 10),
g AS (SELECT k, unnest(list_concat(tok, list_transform(range(1, len(tok)), lambda i: concat(tok[i], ' ', tok[i + 1])))) AS keyword FROM t WHERE len(tok) >= 3),
c AS (SELECT k, keyword, count(*) AS n FROM g GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, keyword) AS place FROM c),
s AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS weight FROM f WHERE place <= 30)
"""


@query("tfidf_keywords", "A6", TFIDF_SQL.format(key="doc_id", text="text", source="documents") + """
SELECT k AS doc_id, place, keyword, round(weight, 6) AS weight FROM s WHERE place <= 15
UNION ALL
SELECT k, row_number() OVER (PARTITION BY k ORDER BY n DESC, pos), word, NULL FROM (
  SELECT k, word, count(*) AS n, min(pos) AS pos FROM (SELECT k, unnest(tok) AS word, generate_subscripts(tok, 1) AS pos FROM t WHERE len(tok) BETWEEN 1 AND 2) GROUP BY ALL)""")
def tfidf_keywords(spark, sf):
    out = W.tfidf_keywords(texts(spark, sf), "doc_id", "text", 15)
    return out.withColumn("weight", F.round("weight", 6))


@query("corpus_keywords", "A6", """
WITH t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^<WD>]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND NOT list_contains(<STOP>, w)) AS tok FROM documents),
c AS (SELECT doc_id, keyword, count(*) AS n FROM (SELECT doc_id, unnest(tok) AS keyword FROM t) GROUP BY ALL),
d AS (SELECT keyword, count(*) AS df FROM c GROUP BY 1),
w AS (SELECT doc_id, keyword, n * ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE)) AS weight FROM c JOIN d USING (keyword))
SELECT doc_id, place, keyword, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, keyword) AS place FROM w) WHERE place <= 10""")
def corpus_keywords(spark, sf):
    """The ten words of each document that set it apart from all others."""
    out = W.corpus_tfidf(texts(spark, sf), "doc_id", "text", 10)
    return out.withColumn("weight", F.round("weight", 6))


@query("keywords_per_task", "A7", TFIDF_SQL.format(key="doc_id * 10 + task_number", text="content", source="v_answers") + """,
simple AS (SELECT k, word AS keyword, row_number() OVER (PARTITION BY k ORDER BY n DESC, pos) AS place FROM (
  SELECT k, word, count(*) AS n, min(pos) AS pos FROM (SELECT k, unnest(tok) AS word, generate_subscripts(tok, 1) AS pos FROM t WHERE len(tok) BETWEEN 1 AND 2) GROUP BY ALL)),
l AS (SELECT k, string_agg(keyword, ', ' ORDER BY place) AS keywords FROM (SELECT k, keyword, place FROM s WHERE place <= 15 UNION ALL SELECT k, keyword, place FROM simple) GROUP BY 1)
SELECT d.doc_id, q.n AS task_number, coalesce(l.keywords, '') AS keywords FROM (SELECT DISTINCT doc_id FROM v_answers) d CROSS JOIN (VALUES (1), (2), (3), (4)) q(n)
LEFT JOIN l ON l.k = d.doc_id * 10 + q.n""", ("v_answers",))
def keywords_per_task(spark, sf):
    return W.keywords_per_task(v_answers(spark, sf)).withColumn("keywords", F.array_join("keywords", ", "))


RANK_SQL = "processing_status <> 'error' AND approved = 1"


@query("select_winners", "W1", f"""
SELECT s.doc_id, CASE WHEN w.doc_id IS NOT NULL THEN 'winner' ELSE s.candidate_status END AS candidate_status FROM {STATES_SQL} s
LEFT JOIN (SELECT doc_id FROM v_submissions WHERE {RANK_SQL} ORDER BY average_score DESC, created_at DESC NULLS LAST, doc_id LIMIT 10) w ON w.doc_id = s.doc_id""", SUBS)
def select_winners(spark, sf):
    return R.select_winners(with_states(spark, sf), 10).select("doc_id", "candidate_status")


@query("leaderboard", "W2", """
SELECT doc_id, row_number() OVER (ORDER BY average_score + CASE WHEN processing_status = 'error' THEN -1000000 WHEN approved = 1 THEN 1000000 ELSE 0 END DESC,
  created_at DESC NULLS LAST, doc_id) AS place
FROM v_submissions""", SUBS)
def leaderboard(spark, sf):
    ranked = v_submissions(spark, sf).select("doc_id", "average_score", "processing_status", "approved", "created_at")
    return R.leaderboard(ranked).select("doc_id", "place")


@query("row_status", "W3", f"""
WITH top AS (SELECT doc_id FROM v_submissions WHERE approved = 1 AND average_score > 0 ORDER BY average_score DESC, created_at DESC NULLS LAST, doc_id LIMIT 10)
SELECT doc_id, CASE WHEN processing_status = 'error' THEN 'blocked' WHEN candidate_status = 'winner' THEN 'winner'
  WHEN doc_id IN (SELECT doc_id FROM top) THEN 'top_n_approved' WHEN approved = 1 AND average_score > 0 THEN 'read' ELSE 'unread' END AS row_status FROM {STATES_SQL}""", SUBS)
def row_status(spark, sf):
    return R.row_status(with_states(spark, sf), 10).select("doc_id", "row_status")


@query("reset_competition", "W4", f"""
SELECT doc_id, CASE WHEN candidate_status IN ('winner', 'recommended') THEN 'read' ELSE candidate_status END AS candidate_status,
  CASE WHEN candidate_status IN ('winner', 'recommended') THEN 0 ELSE messages_sent END AS messages_sent, candidate_status IN ('winner', 'recommended') AS was_reset FROM {STATES_SQL}""", SUBS)
def reset_competition(spark, sf):
    return R.reset_competition(with_states(spark, sf)).select("doc_id", "candidate_status", "messages_sent", "was_reset")


@query("mark_messages_sent", "W5", f"""
SELECT 'before' AS moment, count(*) FILTER (candidate_status = 'winner') AS winners, coalesce(bool_and(messages_sent = 1) FILTER (candidate_status = 'winner'), false) AS all_sent FROM {STATES_SQL}
UNION ALL SELECT 'after', count(*) FILTER (candidate_status = 'winner'), true FROM {STATES_SQL}""", SUBS)
def mark_messages_sent(spark, sf):
    subs = with_states(spark, sf)
    before = R.message_summary(subs).withColumn("moment", F.lit("before"))
    after = R.message_summary(R.mark_messages_sent(subs)).withColumn("moment", F.lit("after"))
    return before.unionByName(after).select("moment", "winners", "all_sent")


@query("task4_percent", "W6", """
SELECT doc_id, CASE WHEN o IS NULL AND l IS NULL THEN '-' WHEN o IS NULL THEN concat(CAST(floor(l + 0.5) AS BIGINT), '%') WHEN l IS NULL THEN concat(CAST(floor(o + 0.5) AS BIGINT), '%')
  ELSE concat(CAST(floor((o + l) / 2 + 0.5) AS BIGINT), '%') END AS task4
FROM (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN average_score * 10 END AS o, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 101)::DOUBLE END AS l FROM v_submissions)""", SUBS)
def task4_percent(spark, sf):
    d = F.col("doc_id")
    originality = F.when(d % 3 != 0, F.col("average_score") * 10)
    logic = F.when(d % 4 != 0, (d % 101).cast("double"))
    return v_submissions(spark, sf).select("doc_id", R.task4_percent(originality, logic).alias("task4"))


@query("enough_approved", "W7", f"""
SELECT count(*) FILTER ({RANK_SQL}) AS approved, 10::BIGINT AS requested, count(*) FILTER ({RANK_SQL}) >= 10 AS enough FROM v_submissions""", SUBS)
def enough_approved(spark, sf):
    return R.enough_approved(v_submissions(spark, sf), 10)
