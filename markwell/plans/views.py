"""Bindings from the raw driver tables to the submission data model, in Spark and in oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.session import spread
from markwell.plans.fixtures import catalogue_values, count_patterns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with text, on all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"))


def v_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns: every four turns of a conversation are the answers of one document."""
    turns = table(spark, sf_dir, "conversations")
    per_conversation = turns.select(F.expr("max(turn) div 4 + 1")).scalar()
    return spread(turns).select(
        (F.col("conv_id") * per_conversation + F.expr("turn div 4")).alias("doc_id"),
        (F.col("turn") % 4 + 1).cast("int").alias("task_number"),
        F.col("text").alias("content"),
    )


def v_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_doc_id")
    events = table(spark, sf_dir, "events").select(F.col("event_id"), F.col("ts"))
    kind = (
        F.when(F.col("doc_id") % 4 == 0, "txt")
        .when(F.col("doc_id") % 4 == 1, "md")
        .when(F.col("doc_id") % 4 == 2, "sql")
        .otherwise("xls")
    )
    return (
        docs.join(labels, docs.doc_id == labels.l_doc_id, "left")
        .join(events, docs.doc_id == events.event_id, "left")
        .select(
            docs.doc_id,
            F.concat(F.lit("doc_"), docs.doc_id, F.lit("."), kind).alias("full_filename"),
            F.concat(F.lit("doc_"), docs.doc_id).alias("filename"),
            kind.alias("type"),
            F.col("text").alias("content"),
            F.sha2("text", 256).alias("file_hash"),
            F.when(F.col("toxic") == 1, "error")
            .when(F.col("l_doc_id").isNull(), "pending")
            .otherwise("completed")
            .alias("processing_status"),
            F.coalesce(F.col("quality"), F.lit(0)).alias("approved"),
            ((F.col("n_chars") % 1001) / F.lit(100.0)).cast("double").alias("average_score"),
            F.col("ts").alias("created_at"),
        )
    )


def v_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items: every eight of them are a key set of 2 kinds x 4 tasks."""
    return table(spark, sf_dir, "benchmark").select(
        F.expr("item_id div 8").alias("key_set"),
        F.when(F.expr("(item_id div 4) % 2") == 0, "hr").otherwise("ai").alias("kind"),
        (F.col("item_id") % 4 + 1).cast("int").alias("task_number"),
        F.col("text").alias("content"),
    )


def key_set_of(spark: SparkSession, sf_dir: str) -> Column:
    """The key set of a document: its id modulo the number of sets."""
    return F.col("doc_id") % table(spark, sf_dir, "benchmark").select(F.expr("max(item_id) div 8 + 1")).scalar()


def v_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 5").alias("doc_id"),
        (F.col("vec_id") % 5).cast("int").alias("slot"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def v_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"),
        F.when(kind == "view", "upload")
        .when(kind == "click", "parsing")
        .when(kind == "signup", "scoring")
        .when(kind == "purchase", "completed")
        .otherwise("error")
        .alias("stage"),
        F.when(kind == "error", "error")
        .when(kind == "purchase", "completed")
        .otherwise("in_progress")
        .alias("status"),
        "ts",
        "value",
        F.col("event_id").alias("seq"),
    )


def v_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per document; a document has at most four answers, so the group is bounded."""
    part = F.concat(F.lit("Вопрос "), F.col("task_number"), F.lit(". "), F.col("content"))
    parts = F.sort_array(F.collect_list(F.struct("task_number", part.alias("part"))))
    return (
        v_answers(spark, sf_dir)
        .groupBy("doc_id")
        .agg(F.array_join(F.transform(parts, lambda p: p.part), "\n").alias("content"))
    )


def v_styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lit = F.col("doc_id"), F.lit

    def when(mod: int, rest: int, text: str):
        return F.when(d % mod == rest, lit(text)).otherwise(lit(""))

    return texts(spark, sf_dir).select(
        "doc_id",
        F.concat(
            when(3, 0, "1. First point\n2. Second point\n"),
            when(4, 1, "• item one\n* item two\n- item three\n"),
            when(5, 2, "It should be noted that it is important to read. "),
            when(7, 3, "Summary: short\nDetails: long\n"),
            F.coalesce("text", lit("")),
            when(6, 4, "  double  spaced,bad — dash 😀 in accordance with"),
            when(2, 0, "\n\nA second paragraph with enough length. lower start."),
        ).alias("content"),
    )


ORACLE_VIEWS: dict[str, str] = {
    "v_answers": """
SELECT conv_id * n + turn // 4 AS doc_id, CAST(turn % 4 + 1 AS INT) AS task_number, text AS content
FROM conversations, (SELECT max(turn) // 4 + 1 AS n FROM conversations)""",
    "v_submissions": """
SELECT d.doc_id, concat('doc_', d.doc_id, '.', t.type) AS full_filename, concat('doc_', d.doc_id) AS filename, t.type,
       d.text AS content, sha256(d.text) AS file_hash,
       CASE WHEN l.toxic = 1 THEN 'error' WHEN l.doc_id IS NULL THEN 'pending' ELSE 'completed' END AS processing_status,
       coalesce(l.quality, 0) AS approved, (d.n_chars % 1001) / CAST(100.0 AS DOUBLE) AS average_score, e.ts AS created_at
FROM documents d
JOIN (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'sql' ELSE 'xls' END AS type
      FROM documents) t ON t.doc_id = d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN events e ON e.event_id = d.doc_id""",
    "v_keys": """
SELECT item_id // 8 AS key_set, CASE WHEN (item_id // 4) % 2 = 0 THEN 'hr' ELSE 'ai' END AS kind, CAST(item_id % 4 + 1 AS INT) AS task_number,
       text AS content, (SELECT max(item_id) // 8 + 1 FROM benchmark) AS n_sets
FROM benchmark""",
    "v_vectors": """
SELECT vec_id // 5 AS doc_id, CAST(vec_id % 5 AS INT) AS slot, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings""",
    "v_progress": """
SELECT user_id AS doc_id,
       CASE event_type WHEN 'view' THEN 'upload' WHEN 'click' THEN 'parsing' WHEN 'signup' THEN 'scoring'
                       WHEN 'purchase' THEN 'completed' ELSE 'error' END AS stage,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' ELSE 'in_progress' END AS status,
       ts, value, event_id AS seq
FROM events""",
    "v_marked": """
SELECT doc_id, string_agg(concat('Вопрос ', task_number, '. ', content), chr(10) ORDER BY task_number) AS content
FROM v_answers GROUP BY doc_id""",
    "v_styled": """
SELECT doc_id, concat(
  CASE WHEN doc_id % 3 = 0 THEN concat('1. First point', chr(10), '2. Second point', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 4 = 1 THEN concat('• item one', chr(10), '* item two', chr(10), '- item three', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 5 = 2 THEN 'It should be noted that it is important to read. ' ELSE '' END,
  CASE WHEN doc_id % 7 = 3 THEN concat('Summary: short', chr(10), 'Details: long', chr(10)) ELSE '' END,
  text,
  CASE WHEN doc_id % 6 = 4 THEN '  double  spaced,bad — dash 😀 in accordance with' ELSE '' END,
  CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), chr(10), 'A second paragraph with enough length. lower start.') ELSE '' END
) AS content FROM documents""",
    # Style metrics of every styled text.
    "v_metrics": """
SELECT doc_id, content,
  CASE WHEN length(trim(content, <CHARS>)) < 10 THEN 0.0 ELSE 206.835 - 1.015 * (nw / CAST(ns AS DOUBLE)) - 84.6 * (ny / CAST(nw AS DOUBLE)) END AS readability,
  total_words, has_emoji, has_long_dash, odd > 0 AS has_special_unicode, odd AS special_chars_count,
  tight, dbl, caps, tight + dbl + caps AS total_errors,
  CASE WHEN trim(content, <CHARS>) = '' THEN 0.0 ELSE least(1.0, CASE WHEN length(trim(content, <CHARS>)) >= 100 AND (contains(content, '. ') OR contains(content, chr(10)))
       THEN greatest(score, CAST(0.05 AS DOUBLE)) ELSE score END) END AS llm_likelihood
FROM (
 SELECT *,
   (CASE WHEN num >= 4 THEN 0.2 WHEN num = 3 THEN 0.15 WHEN num = 2 THEN 0.1 WHEN num = 1 THEN 0.05 ELSE 0 END)::DOUBLE
   + (CASE WHEN bul >= 5 THEN 0.2 WHEN bul >= 2 THEN 0.05 + (bul - 2) * 0.05 WHEN bul = 1 THEN 0.05 ELSE 0 END)::DOUBLE
   + (CASE WHEN phr >= 3 THEN 0.3 WHEN phr = 2 THEN 0.2 WHEN phr = 1 THEN 0.1 ELSE 0 END)::DOUBLE
   + (CASE WHEN hdr >= 4 THEN 0.2 WHEN hdr >= 2 THEN 0.05 + (hdr - 2) * 0.05 WHEN hdr = 1 THEN 0.05 ELSE 0 END)::DOUBLE
   + (CASE WHEN pat >= 2 THEN 0.1 WHEN pat = 1 THEN 0.05 ELSE 0 END)::DOUBLE AS score
 FROM (
  SELECT doc_id, content,
   greatest(1, len(regexp_extract_all(content, '[<WD>]+'))) AS nw, greatest(1, len(regexp_extract_all(content, '[.!?]+'))) AS ns,
   len(regexp_extract_all(lower(content), '[aeiouyàâäáéèêëíîïóôöúùûüœæаеёиоуыэюя]+')) AS ny,
   len(regexp_extract_all(content, '[^<SP>]+')) AS total_words,
   regexp_matches(content, '[<EMOJI>]') AS has_emoji, contains(content, '—') OR contains(content, '–') AS has_long_dash,
   len(regexp_extract_all(content, '[^<WD><SP>.,;:!?\\-()\\[\\]{}\\x22\\x27]')) AS odd,
   len(regexp_extract_all(content, '[.,;:!?][А-Яа-яA-Za-z]')) AS tight, len(regexp_extract_all(content, '  +')) AS dbl,
   len(list_filter(string_split_regex(content, '[.!?][<SP>]+')[2:], lambda s: s <> '' AND NOT regexp_matches(s, '^\\p{Lu}'))) AS caps,
   len(regexp_extract_all(content, '\\d+[.)][<SP>]+[А-Яа-яA-Z]')) AS num,
   least(10, len(regexp_extract_all(content, '[•*]')) + len(regexp_extract_all(content, '(?m)^[<SP>]*[-–][<SP>]+'))) AS bul,
   len(list_filter(<PHRASES>, lambda p: contains(lower(content), p))) AS phr,
   len(regexp_extract_all(content, '(?m)^[А-Яа-яA-Z][^.!?]{0,50}:')) AS hdr,
   len(list_filter(['в[<SP>]+связи[<SP>]+с[<SP>]+тем', 'в[<SP>]+соответствии[<SP>]+с', 'с[<SP>]+учетом[<SP>]+того', 'во-первых', 'во-вторых',
                    'in accordance with', 'with regard to'], lambda p: regexp_matches(content, concat('(?i)', p)))) AS pat
  FROM v_styled))""",
    "v_catalogue": catalogue_values(),
    "v_criteria": """
SELECT doc_id, task_number, criterion_no, name, inverted,
       coalesce(string_agg(keyword, ', ' ORDER BY keyword_no) FILTER (hit), '') AS matched_keywords,
       bool_or(hit) AS matched, bool_or(hit) <> inverted AS passed
FROM (
  SELECT a.doc_id, a.task_number, c.*, CASE WHEN regexp_matches(c.keyword, '[^a-zа-я0-9_]') THEN contains(norm, c.keyword)
      ELSE regexp_matches(norm, concat('(^|[^<WD>])', c.keyword, '($|[^<WD>])')) END AS hit
  FROM (SELECT doc_id, task_number, trim(regexp_replace(lower(content), '[<SP>]+', ' ', 'g')) AS norm FROM v_answers) a
  JOIN v_catalogue c ON c.question = a.task_number)
GROUP BY doc_id, task_number, criterion_no, name, inverted""",
    "v_hashed": """
SELECT doc_id, task_number, content,
  list_transform(range(64), lambda i: CAST(len(list_filter(buckets, lambda b: b = i)) AS DOUBLE)) AS vec
FROM (SELECT doc_id, task_number, content,
        list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(content), '[^<WD><SP>]', ' ', 'g'), '[<SP>]+', ' ', 'g')), ' '), lambda t: t <> ''),
                       lambda t: CAST(concat('0x', md5(t)[1:8]) AS BIGINT) % 64) AS buckets FROM v_answers)""",
    "v_hashed_keys": """
SELECT key_set, kind, task_number, content,
  list_transform(range(64), lambda i: CAST(len(list_filter(buckets, lambda b: b = i)) AS DOUBLE)) AS vec
FROM (SELECT key_set, kind, task_number, content,
        list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(content), '[^<WD><SP>]', ' ', 'g'), '[<SP>]+', ' ', 'g')), ' '), lambda t: t <> ''),
                       lambda t: CAST(concat('0x', md5(t)[1:8]) AS BIGINT) % 64) AS buckets FROM v_keys)""",
    # The evaluation of every (document, question).
    "v_eval": """
SELECT *, CASE WHEN chosen IS NULL THEN NULL ELSE round(greatest(1.0, least(10.0, blend + length_delta
            - CASE WHEN nlen > 0 AND coverage = 0 THEN 1.0 ELSE 0.0 END)), 1) END AS final_score
FROM (
 SELECT *, round(blend, 2) AS blended_score, round(ratio, 3) AS length_ratio,
   CASE WHEN ratio IS NULL THEN 0.0 WHEN ratio < 1 THEN round(-1.5 * (1.0 - ratio), 2)
        ELSE round(CAST(0.5 AS DOUBLE) * greatest(0.0, least(1.0, (ratio - 1.0) / CAST(0.8 AS DOUBLE))), 2) END AS length_delta
 FROM (
  SELECT *, CASE WHEN cosine_score IS NOT NULL THEN greatest(1.0, least(10.0, coalesce(CAST(0.7 AS DOUBLE) * cosine_score + CAST(0.3 AS DOUBLE) * criteria_score, cosine_score))) END AS blend,
    CASE WHEN answer_len > 0 AND ai_key_len > 0 THEN (answer_len + 30) / CAST(ai_key_len + 30 AS DOUBLE) END AS ratio
  FROM (
   SELECT *, CASE WHEN chosen_sim IS NOT NULL THEN round(greatest(1.0, least(10.0, 10.0 * greatest(0.0, least(1.0, (chosen_sim - 0.45::DOUBLE) / (0.90::DOUBLE - 0.45::DOUBLE))))), 1) END AS cosine_score,
     length(trim(content, <CHARS>)) AS answer_len, CASE WHEN chosen IS NULL THEN 0 ELSE length(trim(ai_text, <CHARS>)) END AS ai_key_len,
     length(norm) AS nlen, """ + count_patterns("norm", K.CONCRETENESS_PATTERNS.values()) + """ AS coverage
   FROM (
    SELECT *, trim(regexp_replace(lower(content), '[^<WD>]+', ' ', 'g')) AS norm, CASE WHEN hr_sim IS NULL AND ai_sim IS NULL THEN NULL WHEN ai_sim IS NULL OR hr_sim >= ai_sim THEN 'hr' ELSE 'ai' END AS chosen,
      CASE WHEN hr_sim IS NULL AND ai_sim IS NULL THEN NULL WHEN ai_sim IS NULL OR hr_sim >= ai_sim THEN hr_sim ELSE ai_sim END AS chosen_sim
    FROM (
     SELECT s.doc_id, s.task_number, coalesce(a.content, '') AS content, ai.content AS ai_text,
       round(list_dot_product(a.vec, hr.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(hr.vec, hr.vec)), 4) AS hr_sim,
       round(list_dot_product(a.vec, ai.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(ai.vec, ai.vec)), 4) AS ai_sim,
       c.passed AS criteria_passed, c.total AS criteria_total, round(1.0 + 9.0 * c.passed / CAST(c.total AS DOUBLE), 2) AS criteria_score
     FROM (SELECT d.doc_id, q.task_number, d.doc_id % q.n_sets AS key_set FROM (SELECT DISTINCT doc_id FROM v_answers) d, (SELECT DISTINCT task_number, n_sets FROM v_keys) q) s
     LEFT JOIN v_hashed a ON a.doc_id = s.doc_id AND a.task_number = s.task_number
     LEFT JOIN v_hashed_keys hr ON hr.kind = 'hr' AND hr.task_number = s.task_number AND hr.key_set = s.key_set
     LEFT JOIN v_hashed_keys ai ON ai.kind = 'ai' AND ai.task_number = s.task_number AND ai.key_set = s.key_set
     LEFT JOIN (
       SELECT doc_id, task_number, count(*) FILTER (passed) AS passed, count(*) AS total FROM (
         SELECT doc_id, task_number, passed FROM v_criteria
         UNION ALL
         SELECT m.doc_id, m.question, m.inverted FROM (
           SELECT d.doc_id, c.question, c.criterion_no, c.inverted FROM (SELECT DISTINCT doc_id FROM v_answers) d,
                  (SELECT DISTINCT question, criterion_no, inverted FROM v_catalogue) c) m
         WHERE NOT EXISTS (SELECT 1 FROM v_answers a WHERE a.doc_id = m.doc_id AND a.task_number = m.question))
       GROUP BY ALL) c ON c.doc_id = s.doc_id AND c.task_number = s.task_number)))))""",
    "v_parts": """
SELECT doc_id, task_number, content, CASE doc_id % 6 WHEN 0 THEN concat('Вопрос ', task_number, '. ') WHEN 1 THEN concat('Задание №', task_number, ' ')
    WHEN 2 THEN ['Первое задание: ', 'Второе задание: ', 'Третье задание: ', 'Четвёртое задание: '][task_number] WHEN 3 THEN concat('Ответ на ', task_number, ' ')
    WHEN 4 THEN ['I) ', 'II) ', 'III) ', 'IV) '][task_number] ELSE concat(task_number, '. ') END AS marker FROM v_answers""",
    "v_positions": """
SELECT *, CAST(coalesce(sum(length(marker) + length(content) + 1) OVER (PARTITION BY doc_id ORDER BY task_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS pos FROM v_parts""",
    "v_fragments": """
SELECT doc_id, task_number, unnest(f) AS text, generate_subscripts(f, 1) - 1 AS tail_no FROM (
  SELECT doc_id, task_number, list_filter(CASE WHEN len(paras) >= 2 THEN paras ELSE sents END, lambda x: length(x) >= 20) AS f FROM (
    SELECT doc_id, task_number, list_filter(list_transform(string_split_regex(content, '\\n[<SP>]*\\n'), lambda x: trim(x, <CHARS>)), lambda x: length(x) >= 20) AS paras,
      list_filter(list_transform(string_split_regex(content, '[.!?][<SP>]+'), lambda x: trim(x, <CHARS>)), lambda x: x <> '') AS sents
    FROM v_answers WHERE length(trim(content, <CHARS>)) >= 20))""",
    "v_tails": """
SELECT doc_id, task_number, row_number() OVER (PARTITION BY doc_id, task_number ORDER BY tail_no) - 1 AS tail_no, text, belongs_to_task, similarity FROM (
  SELECT f.doc_id, f.task_number, f.tail_no, f.text, arg_max(o.task_number, sim * 1000 - o.task_number * 1e-9) AS belongs_to_task, max(sim) AS similarity
  FROM (SELECT *, list_transform(range(64), lambda i: CAST(len(list_filter(list_transform(list_filter(string_split(trim(regexp_replace(lower(text), '[^<WD>]+', ' ', 'g')), ' '), lambda t: t <> ''),
            lambda t: CAST(concat('0x', md5(t)[1:8]) AS BIGINT) % 64), lambda b: b = i)) AS DOUBLE)) AS fv FROM v_fragments) f
  JOIN v_hashed o ON o.doc_id = f.doc_id AND o.task_number <> f.task_number,
  LATERAL (SELECT coalesce(list_dot_product(fv, o.vec) / nullif(sqrt(list_dot_product(fv, fv) * list_dot_product(o.vec, o.vec)), 0), 0) AS sim)
  GROUP BY ALL) WHERE similarity > 0.75""",
    "v_moved": """
SELECT s.doc_id, s.n AS task_number, CASE WHEN t.texts IS NULL THEN coalesce(a.content, '') ELSE
    list_reduce(list_concat([coalesce(a.content, '')], t.texts), lambda x, y: trim(replace(x, y, ''), <CHARS>)) END AS content,
  coalesce(r.received, '') AS tails, coalesce(r.n_received, 0) AS n_received
FROM (SELECT DISTINCT doc_id, n FROM v_answers, (VALUES (1), (2), (3), (4)) q(n)) s
LEFT JOIN v_answers a ON a.doc_id = s.doc_id AND a.task_number = s.n
LEFT JOIN (SELECT doc_id, task_number, list(text ORDER BY tail_no) AS texts FROM v_tails GROUP BY ALL) t ON t.doc_id = s.doc_id AND t.task_number = s.n
LEFT JOIN (SELECT doc_id, belongs_to_task, string_agg(text, ' | ' ORDER BY task_number, tail_no) AS received, count(*) AS n_received FROM v_tails GROUP BY ALL) r ON r.doc_id = s.doc_id AND r.belongs_to_task = s.n""",
    "v_pairs": """
SELECT doc_id, other_id, greatest(0.0, (average_task_similarity + content_similarity) / 2) AS overall_similarity, average_task_similarity, content_similarity FROM (
  SELECT a.doc_id, b.doc_id AS other_id, coalesce(avg(sim) FILTER (a.slot > 0), 0) AS average_task_similarity, coalesce(max(sim) FILTER (a.slot = 0), 0) AS content_similarity
  FROM v_vectors a JOIN v_vectors b ON a.slot = b.slot AND a.doc_id <> b.doc_id,
  LATERAL (SELECT list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)) AS sim) GROUP BY ALL)""",
}


def v_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like v_marked, with six marker styles by doc_id."""
    n, d = F.col("task_number"), F.col("doc_id") % 6

    def listed(*names: str):
        return F.element_at(F.array(*[F.lit(x) for x in names]), n)

    marker = (
        F.when(d == 0, F.concat(F.lit("Вопрос "), n, F.lit(". ")))
        .when(d == 1, F.concat(F.lit("Задание №"), n, F.lit(" ")))
        .when(d == 2, listed("Первое задание: ", "Второе задание: ", "Третье задание: ", "Четвёртое задание: "))
        .when(d == 3, F.concat(F.lit("Ответ на "), n, F.lit(" ")))
        .when(d == 4, listed("I) ", "II) ", "III) ", "IV) "))
        .otherwise(F.concat(n, F.lit(". ")))
    )
    parts = F.sort_array(F.collect_list(F.struct("task_number", F.concat(marker, "content").alias("part"))))
    return (
        v_answers(spark, sf_dir)
        .groupBy("doc_id")
        .agg(F.array_join(F.transform(parts, lambda p: p.part), "\n").alias("content"))
    )
