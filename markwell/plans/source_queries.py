"""Sources and sinks: files and JSON are derived by Spark from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwell.functions.registry import _CP1251_HIGH, _LATIN1_HIGH, decode_text
from markwell.operators import answers as A
from markwell.operators import integrity, similarity
from markwell.plans.catalog import query
from markwell.plans.scoring_queries import evaluation
from markwell.plans.views import table, v_answers, v_marked, v_submissions, v_vectors
from markwell.sources import answers_json as J
from markwell.sources import exports as E
from markwell.sources import files as S


@query("scan_submissions", "S1", """
SELECT 'txt' AS type, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) + 1) AS BIGINT) AS characters FROM documents""")
def scan_submissions(spark, sf):
    """All documents are written as text files (fifty per file, far below the size limit) and scanned."""
    folder = S.scratch_dir(spark) + "/files"
    table(spark, sf, "documents").select("text").write.option("maxRecordsPerFile", 50).text(folder)
    files = S.decode_files(S.scan_submissions(spark, folder))
    return files.groupBy("type").agg(F.sum("size").alias("bytes"), F.sum(F.length("content").cast("bigint")).alias("characters"))


@query("decode_text", "S2", """
SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN content ELSE regexp_replace(content, '[^\\x01-\\x7FА-Яа-я]', '', 'g') END AS content FROM v_marked""", ("v_answers", "v_marked"))
def decode(spark, sf):
    """Odd documents as UTF-8 bytes, even ones as single-byte Cyrillic."""
    narrow = F.regexp_replace("content", r"[^\x01-\x7FА-Яа-я]", "")
    single = F.encode(F.translate(narrow, _CP1251_HIGH, _LATIN1_HIGH), "ISO-8859-1")
    data = F.when(F.col("doc_id") % 2 == 1, F.encode("content", "UTF-8")).otherwise(single)
    return v_marked(spark, sf).select("doc_id", data.alias("data")).select("doc_id", decode_text(F.col("data")).alias("content"))


@query("read_reference_answers", "S4", """
SELECT doc_id AS source_id, task_number, CASE WHEN task_number = 1 THEN 'again' ELSE trim(content, <CHARS>) END AS content FROM v_answers""", ("v_answers",))
def read_reference_answers(spark, sf):
    """Each submission as a reference text; answer 1 is repeated at the end and the last one wins."""
    part = F.concat(F.lit("ОТВЕТ "), "task_number", F.lit(".\n"), "content")
    texts = v_answers(spark, sf).groupBy(F.col("doc_id").alias("source_id")).agg(
        F.sort_array(F.collect_list(F.struct("task_number", part.alias("p")))).alias("ps")  # at most four parts
    )
    text = F.concat(F.lit("intro\n"), F.array_join(F.transform("ps", lambda p: p["p"]), "\n"), F.lit("\nответ 1. again"))
    return S.cut_reference_answers(texts.select("source_id", text.alias("content")))


@query("read_answer_keys", "S5", """
SELECT item_id // 4 AS file_id, CAST(item_id % 4 + 1 AS INT) AS task_number, CASE WHEN item_id % 4 = 2 THEN '' ELSE text END AS content FROM benchmark""")
def read_answer_keys(spark, sf):
    """Key files of four items each, made from all benchmark texts."""
    n = F.col("item_id") % 4 + 1
    item = F.struct(F.concat(F.lit("Вопрос "), n).alias("task_number"), F.when(n != 3, F.col("text")).alias("content"))
    docs = table(spark, sf, "benchmark").groupBy(F.expr("item_id div 4").alias("file_id")).agg(
        F.to_json(F.collect_list(item)).alias("json")
    )
    return J.read_answer_keys(docs, "file_id")


@query("flatten_nested_answer", "S6", """
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN concat('[draft] ', url) ELSE concat('url: ', url, chr(10), 'n: ', page_id, chr(10), 'ok: ', CASE WHEN page_id % 2 = 0 THEN 'True' ELSE 'False' END, chr(10), 'list:', chr(10), ' - a', chr(10), ' - b', page_id, chr(10), 'sub:', chr(10), 'x: 1', chr(10),
  'deep:', chr(10), 'a:', chr(10), 'b:', chr(10), 'c:', chr(10), 'd:', chr(10), ' - - e', page_id, chr(10), ' - f', chr(10), 'note: [1] see below', chr(10), 'empty:') END AS content FROM pages""")
def flatten_nested_answer(spark, sf):
    p = F.col("page_id")
    # six levels of objects and lists; a map keeps the inner text as it stands
    deep = F.concat(F.lit('{"a": {"b": {"c": {"d": [["e'), p, F.lit('"], "f"]}}}}'))
    body = F.struct(
        F.col("url"), p.alias("n"), (p % 2 == 0).alias("ok"), F.array(F.lit("a"), F.concat(F.lit("b"), p)).alias("list"),
        F.struct(F.lit(1).alias("x")).alias("sub"), F.from_json(deep, "map<string,string>").alias("deep"), F.lit("[1] see below").alias("note"), F.lit(" ").alias("empty"),
    )
    raw = F.when(p % 5 == 4, F.concat(F.lit("[draft] "), "url")).otherwise(F.to_json(body))  # some answers only look like JSON
    return J.flatten_nested(table(spark, sf, "pages").select("page_id", raw.alias("content")), "content")


@query("read_candidate_json", "S7", """
SELECT d.doc_id, q.n AS task_number, CASE WHEN d.doc_id % 3 <> 2 THEN coalesce(trim(a.content, <CHARS>), '') END AS content,
  CASE d.doc_id % 3 WHEN 0 THEN 'dict_with_tasks' WHEN 1 THEN 'list' END AS candidate_format, CASE WHEN d.doc_id % 3 = 0 THEN concat('doc_', d.doc_id, '.', CASE d.doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'sql' ELSE 'xls' END) END AS filename
FROM (SELECT DISTINCT doc_id FROM v_answers) d JOIN (VALUES (1), (2), (3), (4), (NULL)) q(n) ON (d.doc_id % 3 = 2) = (q.n IS NULL)
LEFT JOIN v_answers a ON a.doc_id = d.doc_id AND a.task_number = q.n""", ("v_answers",))
def read_candidate_json(spark, sf):
    """A third of the texts in object form, a third as lists, a third broken."""
    docs = v_submissions(spark, sf).select("doc_id", "full_filename", "type")
    texts = J.candidate_json(docs, A.pack(v_answers(spark, sf)))
    d = F.col("doc_id") % 3
    mixed = F.when(d == 0, F.col("json")).when(d == 1, F.get_json_object("json", "$.tasks")).otherwise("{broken")
    out = J.read_candidate_json(texts.select("doc_id", mixed.alias("json")))
    return out.select("doc_id", "task_number", "content", "candidate_format", "filename")


@query("read_task_prompts", "S8", """
SELECT q.n AS task_number, coalesce((SELECT content FROM v_answers a WHERE a.task_number = q.n AND a.doc_id = (SELECT min(doc_id) FROM v_answers)), '') AS prompt
FROM (VALUES (1), (2), (3), (4)) q(n)""", ("v_answers",))
def read_task_prompts(spark, sf):
    path = S.scratch_dir(spark) + "/prompts"
    first = A.pack(v_answers(spark, sf)).orderBy("doc_id").limit(1).drop("doc_id")  # only the first row is read
    E.write_csv(first, path)
    return S.read_task_prompts(spark, path)


@query("json_columns", "S10", """
SELECT event_id, props AS text, CASE WHEN event_id % 6 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, concat('[', value, ',', value, ']') AS vec_text FROM events""")
def json_columns(spark, sf):
    raw = F.when(F.col("event_id") % 6 == 0, "not json").otherwise(F.col("props"))
    fallback = F.struct(F.lit(-1).cast("bigint").alias("k"))
    vec = J.to_text(F.array("value", "value"))
    return table(spark, sf, "events").select(
        "event_id", F.col("props").alias("text"), J.parse_or_default(raw, "struct<k:bigint>", fallback)["k"].alias("k"), vec.alias("vec_text")
    )


def documents(spark, sf):
    return v_submissions(spark, sf).select("doc_id", "full_filename", "type", "content", "created_at")


NAME_SQL = "concat('doc_', a.doc_id, '.', CASE a.doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'sql' ELSE 'xls' END)"
FLAT = "trim(regexp_replace({}, '[<SP>]+', ' ', 'g'))"


@query("export_wide", "S11", f"""
WITH p AS (SELECT doc_id, list({FLAT.format('content')} ORDER BY task_number) AS t FROM v_answers WHERE doc_id % 5 <> 0 OR task_number <> 1 GROUP BY 1)
SELECT s.full_filename, s.filename, s.type, coalesce(t[1], '') AS task_1, coalesce(t[2], '') AS task_2, coalesce(t[3], '') AS task_3, coalesce(t[4], '') AS task_4,
  {FLAT.format('s.content')} AS content FROM v_submissions s LEFT JOIN p ON s.doc_id = p.doc_id""", ("v_answers", "v_submissions"))
def export_wide(spark, sf):
    blank = (F.col("doc_id") % 5 == 0) & (F.col("task_number") == 1)
    answers = v_answers(spark, sf).withColumn("content", F.when(blank, "").otherwise(F.col("content")))
    return E.export_wide(documents(spark, sf), A.pack(answers))


@query("export_long", "S12", f"""
SELECT {NAME_SQL} AS filename, s.type AS file_type, s.created_at AS parsed_at, a.task_number,
  CASE WHEN length({FLAT.format('a.content')}) > 5000 THEN concat(left({FLAT.format('a.content')}, 5000), '...') ELSE {FLAT.format('a.content')} END AS task_content
FROM v_answers a JOIN v_submissions s ON s.doc_id = a.doc_id""", ("v_answers", "v_submissions"))
def export_long(spark, sf):
    return E.export_long(documents(spark, sf), v_answers(spark, sf))


@query("export_full", "S13", """
SELECT doc_id, filename, processing_status, approved FROM v_submissions""", ("v_submissions",))
def export_full(spark, sf):
    """Written to CSV with a byte order mark and nested values as JSON, then read back."""
    path = S.scratch_dir(spark) + "/full"
    subs = v_submissions(spark, sf).select(
        "doc_id", "filename", "content", F.struct("processing_status", "approved").alias("state")
    )
    E.write_csv(E.export_full(subs), path, bom=True)
    back = S.read_submission_csv(spark, path)
    named = back.toDF(*[c.removeprefix("﻿") for c in back.columns])
    state = F.from_json("state", "struct<processing_status:string,approved:int>")
    return named.select(F.col("doc_id").cast("bigint").alias("doc_id"), "filename", state.alias("s")).select("doc_id", "filename", "s.*")


@query("export_summary", "S14", """
SELECT full_filename AS filename, 4 AS tasks_count, printf('%.1f%%', round(average_score * 10, 1)) AS similarity_1, CAST(CAST(floor(average_score + 0.5) AS BIGINT) AS VARCHAR) AS score_1, '-' AS similarity_2, '-' AS score_2,
  CASE WHEN doc_id % 2 = 0 THEN printf('%.1f%%', round((doc_id % 10) * 10.0, 1)) ELSE '-' END AS similarity_3, '7' AS score_3, printf('%.1f', round(average_score, 1)) AS average,
  concat(doc_id % 101, '%') AS logic, '-' AS originality, '12.5%' AS max_similarity, CASE WHEN doc_id % 2 = 0 THEN '50.0%' ELSE '-' END AS likelihood FROM v_submissions""", ("v_submissions",))
def export_summary(spark, sf):
    d, avg, none = F.col("doc_id"), F.col("average_score"), F.lit(None).cast("double")
    rows = v_submissions(spark, sf).select(
        "full_filename", F.lit(4).alias("tasks_count"), (avg / 10).alias("sim_1"), avg.alias("score_1"), none.alias("sim_2"),
        none.alias("score_2"), F.when(d % 2 == 0, (d % 10) / F.lit(10.0)).alias("sim_3"), F.lit(6.5).alias("score_3"),
        avg.alias("average"), (d % 101).cast("double").alias("logic"), none.alias("originality"),
        F.lit(0.125).alias("max_similarity"), F.when(d % 2 == 0, 0.5).alias("likelihood"),
    )
    return E.export_summary(rows)


@query("action_log", "S15", """
SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, event_type AS action, user_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'ann' END AS "user",
  concat('value=', value, ', props=', props) AS details, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def action_log(spark, sf):
    """Every event as a log line: rendered, appended by day, read back and parsed."""
    path = S.scratch_dir(spark) + "/log"
    details = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("props"), F.col("props"))
    line = E.render_action(
        F.col("ts"), F.col("event_type"), F.col("user_id"), F.when(F.col("event_id") % 2 == 0, "ann"), details,
        F.when(F.col("event_type") == "error", "error").otherwise("success"),
    )
    day = F.date_format("ts", "yyyy-MM-dd")
    E.append_actions(table(spark, sf, "events").select(line.alias("line"), day.alias("day")), path)
    out = E.read_actions(spark, path)
    return out.select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "action", "doc_id", "user", "details", "status",
        F.date_format(F.to_date(F.col("day").cast("string")), "yyyy-MM-dd").alias("day"),
    )


@query("wide_table", "S13b")
def wide_table(spark, sf):
    """The stored submission in full: answers, similarity, style and grades as one typed row."""
    subs = documents(spark, sf).select("doc_id", "full_filename")
    answers = v_answers(spark, sf)
    grades = evaluation(spark, sf).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("task_number") == k, F.col("final_score"))).alias(f"task_{k}_score") for k in (1, 2, 3)]
    )
    top = similarity.top_similar_nested(similarity.top_similar(v_vectors(spark, sf)))
    checked = integrity.analyze_submission(answers, v_marked(spark, sf))
    joined = subs.join(A.pivot_tasks(answers), "doc_id", "left").join(grades, "doc_id", "left").join(top, "doc_id", "left")
    return E.export_full(joined.join(checked, "doc_id", "left"))
