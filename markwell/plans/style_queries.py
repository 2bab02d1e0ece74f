"""Writing-style metrics: one scan, everything computed inside the row."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwell.functions import style
from markwell.functions import text as T
from markwell.operators import integrity
from markwell.plans.catalog import query
from markwell.plans.views import ORACLE_VIEWS, key_set_of, texts, v_answers, v_keys, v_marked, v_styled
from markwell.session import broadcast_if_small

STYLED = ("v_styled", "v_metrics")


@query("readability", "I1", "SELECT doc_id, round(readability, 4) AS readability FROM v_metrics", STYLED)
def readability(spark, sf):
    return v_styled(spark, sf).select("doc_id", F.round(style.readability("content"), 4).alias("readability"))


@query("word_counts", "I2", """
SELECT doc_id, 0 AS adjectives_count, 0 AS adverbs_count, total_words FROM v_metrics""", STYLED)
def word_counts(spark, sf):
    m = v_styled(spark, sf).select("doc_id", style.analyze_text("content").alias("m"))
    return m.select("doc_id", "m.adjectives_count", "m.adverbs_count", "m.total_words")


@query("special_characters", "I3", """
SELECT doc_id, has_emoji, has_long_dash, has_special_unicode, special_chars_count FROM v_metrics""", STYLED)
def special_characters(spark, sf):
    return v_styled(spark, sf).select("doc_id", style.special_characters("content").alias("s")).select("doc_id", "s.*")


@query("punctuation_errors", "I4", """
SELECT doc_id, tight AS missing_spaces_after_punctuation, dbl AS double_spaces, caps AS missing_capitalization, total_errors
FROM v_metrics""", STYLED)
def punctuation_errors(spark, sf):
    return v_styled(spark, sf).select("doc_id", style.punctuation_errors("content").alias("e")).select("doc_id", "e.*")


@query("llm_likelihood", "I5", "SELECT doc_id, round(llm_likelihood, 4) AS llm_likelihood FROM v_metrics", STYLED)
def llm_likelihood(spark, sf):
    return v_styled(spark, sf).select("doc_id", F.round(style.llm_likelihood("content"), 4).alias("llm_likelihood"))


@query("analyze_text", "I6", """
SELECT doc_id, round(readability, 4) AS readability, total_words, has_emoji, has_long_dash, special_chars_count, total_errors,
       round(llm_likelihood, 4) AS llm_likelihood FROM v_metrics""", STYLED)
def analyze_text(spark, sf):
    m = v_styled(spark, sf).select("doc_id", style.analyze_text("content").alias("m"))
    return m.select(
        "doc_id", F.round("m.readability", 4).alias("readability"), "m.total_words", "m.special_chars.has_emoji",
        "m.special_chars.has_long_dash", "m.special_chars.special_chars_count", "m.punctuation_errors.total_errors",
        F.round("m.llm_likelihood", 4).alias("llm_likelihood"),
    )


LIKELIHOOD_SQL = """
least(1.0, CASE WHEN length(trim(t, <CHARS>)) >= 100 AND (contains(t, '. ') OR contains(t, chr(10))) THEN greatest(0.05::DOUBLE, h) ELSE h END)"""


ANALYZED_SQL = f"""
WITH texts AS (SELECT doc_id, 1 AS is_answer, content AS t FROM v_answers UNION ALL SELECT doc_id, 0, content FROM v_marked),
counted AS (SELECT *, len(regexp_extract_all(t, '\\d+[.)][<SP>]+[А-Яа-яA-Z]')) AS num,
   least(10, len(regexp_extract_all(t, '[•*]')) + len(regexp_extract_all(t, '(?m)^[<SP>]*[-–][<SP>]+'))) AS bul,
   len(regexp_extract_all(t, '(?m)^[А-Яа-яA-Z][^.!?]{{0,50}}:')) AS hdr FROM texts),
scored AS (SELECT doc_id, is_answer, t, (CASE WHEN num >= 4 THEN 0.2 ELSE num * 0.05 END
   + CASE WHEN bul >= 5 THEN 0.2 WHEN bul >= 2 THEN 0.05 + (bul - 2) * 0.05 WHEN bul = 1 THEN 0.05 ELSE 0 END
   + CASE WHEN hdr >= 4 THEN 0.2 WHEN hdr >= 2 THEN 0.05 + (hdr - 2) * 0.05 WHEN hdr = 1 THEN 0.05 ELSE 0 END)::DOUBLE AS h FROM counted),
final AS (SELECT doc_id, is_answer, {LIKELIHOOD_SQL} AS p FROM scored WHERE trim(t, <CHARS>) <> '')
SELECT doc_id, round(coalesce(avg(p) FILTER (is_answer = 1), 0), 4) AS average_llm_likelihood, round(max(p) FILTER (is_answer = 0), 4) AS content_llm_likelihood,
       count(*) FILTER (is_answer = 1) AS answers_analyzed FROM final GROUP BY doc_id"""


@query("analyze_submission", "I7", ANALYZED_SQL, ("v_answers", "v_marked"))
def analyze_submission(spark, sf):
    out = integrity.analyze_submission(v_answers(spark, sf), v_marked(spark, sf))
    return out.withColumns({c: F.round(c, 4) for c in ("average_llm_likelihood", "content_llm_likelihood")})


@query("reference_style_f1", "I8", """
WITH doc AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^<WD><SP>]', ' ', 'g'), '[<SP>]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents),
ref AS (SELECT key_set, n_sets, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(content), '[^<WD><SP>]', ' ', 'g'), '[<SP>]+', ' ', 'g')), ' '), lambda w: w <> '') AS r FROM v_keys),
pr AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains(r, x))) / len(w)::DOUBLE AS p, len(list_filter(r, lambda x: list_contains(w, x))) / len(r)::DOUBLE AS c
       FROM doc JOIN ref ON ref.key_set = doc.doc_id % ref.n_sets WHERE len(w) > 0)
SELECT d.doc_id, round(coalesce(max(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END), 0), 6) AS style_f1
FROM doc d LEFT JOIN pr ON pr.doc_id = d.doc_id GROUP BY d.doc_id""", ("v_keys",))
def reference_style_f1(spark, sf):
    """Every document against the lines of its own key set."""
    words = F.filter(F.split(T.normalize_strip_punct("content"), " "), lambda w: F.length(w) > 0)
    sets = v_keys(spark, sf).select("key_set", words.alias("w")).groupBy("key_set").agg(F.collect_list("w").alias("lines"))  # eight lines
    docs = texts(spark, sf).withColumn("key_set", key_set_of(spark, sf)).join(broadcast_if_small(sets), "key_set", "left")
    return docs.select("doc_id", F.round(style.reference_f1_of("text", "lines"), 6).alias("style_f1"))


# Style metrics of every answer that is not blank.
ANSWER_METRICS = ORACLE_VIEWS["v_metrics"].replace(
    "FROM v_styled", "FROM (SELECT doc_id * 10 + task_number AS doc_id, content FROM v_answers WHERE trim(content, <CHARS>) <> '')"
)


@query("answer_metrics", "I7", f"""
SELECT doc_id // 10 AS doc_id, CAST(doc_id % 10 AS INT) AS task_number, round(readability, 4) AS readability, total_words, has_emoji, total_errors, round(llm_likelihood, 4) AS llm_likelihood
FROM ({ANSWER_METRICS})""", ("v_answers",))
def answer_metrics(spark, sf):
    m = integrity.analyze_answers(v_answers(spark, sf))
    return m.select(
        "doc_id", "task_number", F.round("metrics.readability", 4).alias("readability"), "metrics.total_words",
        "metrics.special_chars.has_emoji", "metrics.punctuation_errors.total_errors",
        F.round("metrics.llm_likelihood", 4).alias("llm_likelihood"),
    )
