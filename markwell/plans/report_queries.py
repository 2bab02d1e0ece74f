"""Reports, comments and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwell import constants as K
from markwell import prompts as P
from markwell.functions import style
from markwell.operators import answers as A
from markwell.operators import integrity
from markwell.operators import reports as R
from markwell.operators import similarity
from markwell.plans.catalog import query
from markwell.plans.fixtures import _q as q
from markwell.plans.scoring_queries import EVAL, evaluation
from markwell.plans.style_queries import ANALYZED_SQL
from markwell.plans.views import table, v_answers, v_marked, v_styled, v_submissions, v_vectors

TIME = "2024-06-01 12:00:00"
DETAILS_SQL = """
details AS (
  SELECT e.doc_id, e.task_number, string_agg(c.name, ', ' ORDER BY c.criterion_no) FILTER (p) AS passed, string_agg(c.name, ', ' ORDER BY c.criterion_no) FILTER (NOT p) AS failed,
    count(*) FILTER (p) AS np, count(c.name) AS n
  FROM v_eval e LEFT JOIN (SELECT DISTINCT question, criterion_no, name, inverted FROM v_catalogue) c ON c.question = e.task_number
  LEFT JOIN v_criteria m ON m.doc_id = e.doc_id AND m.task_number = e.task_number AND m.criterion_no = c.criterion_no,
  LATERAL (SELECT CASE WHEN c.name IS NULL THEN NULL ELSE coalesce(m.passed, c.inverted) END AS p) GROUP BY ALL)"""


def documents(spark, sf):
    return v_submissions(spark, sf).select("doc_id", "filename", "type", "processing_status")


def answered(spark, sf):
    ids = v_answers(spark, sf).select("doc_id").distinct()
    return ids.withColumns({"filename": F.concat(F.lit("doc_"), "doc_id"), "type": F.lit("txt")})


# The organizer's report of every document, as the table ``organizer`` (doc_id, recommended, report).
ORGANIZER_SQL = f"""{DETAILS_SQL.strip()},
blocks AS (SELECT e.doc_id, e.task_number, e.final_score, d.np, d.n, concat('Задание ', e.task_number, chr(10), 'Выполненные критерии: ', coalesce(d.passed, '—'), chr(10),
   'Не выполненные критерии: ', coalesce(d.failed, '—'), chr(10), 'Балл: ', coalesce(printf('%.1f', e.final_score), '—'), chr(10)) AS b
  FROM v_eval e JOIN details d ON d.doc_id = e.doc_id AND d.task_number = e.task_number WHERE e.task_number <= 3),
g AS (SELECT doc_id, string_agg(b, chr(10) ORDER BY task_number) AS body, round(avg(final_score), 2) AS overall, sum(np) / sum(n) AS ratio FROM blocks GROUP BY 1),
organizer AS (SELECT doc_id, ratio >= 0.5 AND coalesce(overall, 0) >= 6 AS recommended, concat('Кандидат: ', doc_id, ' (файл: doc_', doc_id, ')', chr(10), 'Дата: {TIME}', chr(10), chr(10), body, chr(10),
  'Итоговый балл (среднее за задания 1–3): ', coalesce(printf('%.2f', overall), 'нет данных'), chr(10),
  CASE WHEN ratio >= 0.5 AND coalesce(overall, 0) >= 6 THEN 'Рекомендация: кандидат рекомендуется.' ELSE 'Рекомендация: кандидат не рекомендуется.' END) AS report FROM g)"""


@query("organizer_report", "P1", f"WITH {ORGANIZER_SQL} SELECT doc_id, recommended, report FROM organizer", EVAL)
def organizer_report(spark, sf):
    return R.organizer_report(answered(spark, sf), evaluation(spark, sf), F.lit(TIME))


@query("recommendation", "P2", f"""
WITH {DETAILS_SQL},
g AS (SELECT e.doc_id, sum(d.np) / sum(d.n) AS ratio, coalesce(round(avg(e.final_score), 2), 0) AS overall FROM v_eval e JOIN details d ON d.doc_id = e.doc_id AND d.task_number = e.task_number
      WHERE e.task_number <= 3 GROUP BY 1)
SELECT doc_id, round(ratio, 4) AS criteria_ratio, overall, ratio >= 0.5 AND overall >= 6 AS recommended FROM g""", EVAL)
def recommendation(spark, sf):
    return R.recommendation(evaluation(spark, sf))


def _shown(label: str, names: str) -> str:
    """The first three names of a list, and how many follow; NULL without any."""
    more = f"CASE WHEN len({names}) > 3 THEN concat(' (+', len({names}) - 3, ' других)') ELSE '' END"
    return f"CASE WHEN len({names}) > 0 THEN concat('  - {label}: ', array_to_string({names}[1:3], ', '), {more}) END"


@query("hr_report", "P3", f"""
WITH names AS (
  SELECT e.doc_id, e.task_number, list(c.name ORDER BY c.criterion_no) FILTER (coalesce(m.passed, c.inverted)) AS p, list(c.name ORDER BY c.criterion_no) FILTER (NOT coalesce(m.passed, c.inverted)) AS f
  FROM v_eval e JOIN (SELECT DISTINCT question, criterion_no, name, inverted FROM v_catalogue) c ON c.question = e.task_number
  LEFT JOIN v_criteria m ON m.doc_id = e.doc_id AND m.task_number = e.task_number AND m.criterion_no = c.criterion_no GROUP BY ALL),
q AS (SELECT e.*, coalesce(n.p, []) AS p, coalesce(n.f, []) AS f FROM v_eval e LEFT JOIN names n ON n.doc_id = e.doc_id AND n.task_number = e.task_number),
blocks AS (SELECT doc_id, task_number, final_score, content, concat_ws(chr(10), '{R.RULE}',
    concat('Вопрос ', task_number, CASE WHEN task_number <= 3 THEN '' ELSE ' (справочно, не учитывается в итоговой оценке)' END),
    coalesce('Семантическое сходство: выбран ' || CASE WHEN chosen = 'hr' THEN 'HR' ELSE 'AI' END || '-эталон (' || printf('%.4f', chosen_sim) || ')', 'Семантическое сходство: не рассчитано (нет эталона)'),
    concat('Критерии: выполнено ', len(p), ' из ', len(p) + len(f)), {_shown('Выполненные', 'p')}, {_shown('Не выполненные', 'f')}, 'Как рассчитана оценка:',
    coalesce('  - Семантическое сходство с эталоном (1..10): ' || printf('%.1f', cosine_score), '  - Семантическое сходство (1..10): не рассчитано'),
    coalesce('  - Выполнение критериев (1..10): ' || printf('%.1f', round(criteria_score + 1e-9, 1)), '  - Выполнение критериев (1..10): не применялось/нет данных'),
    coalesce('  - Взвешенный балл до штрафов (70% cosine + 30% criteria): ' || printf('%.2f', blended_score), '  - Взвешенный балл до штрафов: нет данных'),
    CASE WHEN length_delta < 0 THEN '  - Штраф за длину (короче AI-эталона): ' || printf('%.2f', length_delta) WHEN length_delta > 0 THEN '  - Бонус за длину (длиннее AI-эталона): +' || printf('%.2f', length_delta)
         ELSE '  - Поправка за длину: 0.00' END,
    coalesce('  - Итоговая оценка: ' || printf('%.1f', final_score), '  - Итоговая оценка: нет данных'), '', 'Результат системы:',
    CASE WHEN final_score IS NULL THEN '{K.GRADE_NONE}' {" ".join(f"WHEN final_score >= {low} THEN '{text}'" for low, text in K.GRADE_BANDS)} ELSE '{K.GRADE_LOW}' END, '') AS b FROM q),
docs AS (SELECT doc_id, string_agg(b, chr(10) ORDER BY task_number) AS body, round(avg(final_score) FILTER (task_number <= 3), 2) AS overall,
    string_agg(concat('• Вопрос ', task_number, ': у кандидата нет ответа или пусто.'), chr(10) ORDER BY task_number) FILTER (content = '') AS warnings FROM blocks GROUP BY 1)
SELECT doc_id, concat_ws(chr(10), '=== ОТЧЁТ ДЛЯ HR ===', 'Дата анализа: {TIME}', concat('Кандидат: ', doc_id, ' (файл: doc_', doc_id, ')'), 'Тип файла: txt', '',
  '=== ПРЕДУПРЕЖДЕНИЯ ===' || chr(10) || warnings || chr(10), body, '{R.RULE}',
  coalesce('Итоговая оценка работы: ' || printf('%.2f', overall) || ' (среднее по вопросам 1–3)', 'Итоговая оценка работы: нет данных (не удалось посчитать среднее по вопросам 1–3)')) AS report FROM docs""", EVAL)
def hr_report(spark, sf):
    return R.hr_report(answered(spark, sf), evaluation(spark, sf), F.lit(TIME))


@query("candidate_report", "P4", f"""
WITH {DETAILS_SQL},
blocks AS (SELECT e.doc_id, e.task_number, e.final_score, concat('В ', e.task_number, ' задании вы использовали:', chr(10), coalesce('+ ' || replace(d.passed, ', ', chr(10) || '+ '), '—'),
   coalesce(concat(chr(10), 'Еще было необходимо:', chr(10)) || '- ' || replace(d.failed, ', ', chr(10) || '- '), ''), chr(10)) AS b
  FROM v_eval e JOIN details d ON d.doc_id = e.doc_id AND d.task_number = e.task_number WHERE e.task_number <= 3)
SELECT doc_id, concat('Здравствуйте! По итогам вашей работы: ', chr(10), string_agg(b, chr(10) ORDER BY task_number), chr(10), 'Итоговый балл: ', coalesce(printf('%.2f', round(avg(final_score), 2)), '—'), '. Спасибо за участие!') AS report
FROM blocks GROUP BY 1""", EVAL)
def candidate_report(spark, sf):
    return R.candidate_report(answered(spark, sf), evaluation(spark, sf))


@query("fallback_comment", "P5", """
SELECT doc_id, concat_ws(' ', CASE WHEN average_score >= 8 THEN 'Ответ демонстрирует высокую схожесть с эталонным решением.' WHEN average_score >= 6 THEN 'Ответ в целом соответствует эталону, но есть некоторые расхождения.' ELSE 'Ответ имеет низкую схожесть с эталонным решением.' END,
  CASE WHEN doc_id % 11 > 7 THEN 'Обнаружены признаки возможного использования автоматизированных инструментов.' WHEN doc_id % 11 < 3 THEN 'Текст выглядит оригинальным и написанным самостоятельно.' END,
  'Рекомендуется обратить внимание на детали и полноту ответа.') AS comment FROM v_submissions""", ("v_submissions",))
def fallback_comment(spark, sf):
    likelihood = (F.col("doc_id") % 11) / F.lit(10.0)
    comment = R.fallback_comment(F.col("average_score") / 10, likelihood)
    return v_submissions(spark, sf).select("doc_id", comment.alias("comment"))


@query("fallback_impression", "P6", """
SELECT doc_id, concat('Уважаемый кандидат, спасибо за вашу работу!', chr(10), chr(10),
  CASE WHEN average_score >= 7 AND doc_id % 10 >= 7 THEN 'Работа демонстрирует хорошее понимание материала Ответы соответствуют эталонным решениям.' WHEN average_score >= 7 THEN 'Работа демонстрирует хорошее понимание материала.'
       WHEN doc_id % 10 >= 7 THEN 'Ответы соответствуют эталонным решениям.' ELSE 'Работа выполнена в установленные сроки.' END, chr(10), chr(10),
  '• Рекомендуется обратить внимание на детализацию ответов и полноту раскрытия темы.', chr(10), chr(10), 'Желаем успехов в профессиональной деятельности!',
  CASE WHEN approved = 1 THEN ' Наш менеджер в скором времени свяжется с вами!' ELSE '' END) AS impression,
  concat('Уважаемый кандидат, спасибо за вашу работу! ', full_filename, ' ', CASE WHEN approved = 1 THEN 'Наш менеджер в скором времени свяжется с вами!' ELSE 'Желаем успехов в профессиональной деятельности!' END) AS repaired
FROM v_submissions""", ("v_submissions",))
def fallback_impression(spark, sf):
    winner = F.col("approved") == 1
    return v_submissions(spark, sf).select(
        "doc_id", R.fallback_impression(F.col("average_score"), (F.col("doc_id") % 10) / F.lit(10.0), winner).alias("impression"),
        R.repair_impression(F.concat(F.lit(" "), "full_filename", F.lit("\n")), winner).alias("repaired"),
    )


def _sql_fill(template: str, **values: str) -> str:
    out = q(template)
    for name, expr in values.items():
        out = out.replace("{" + name + "}", f"', {expr}, '")
    return f"concat({out})"


@query("build_prompts", "P7", f"""
WITH a AS (SELECT doc_id, task_number, content, (doc_id % 10) / 10.0 AS sim FROM v_answers),
p AS (SELECT doc_id, coalesce(max(content) FILTER (task_number = 1), '') AS c1, coalesce(max(content) FILTER (task_number = 2), '') AS c2, coalesce(max(content) FILTER (task_number = 3), '') AS c3,
        coalesce(max(content) FILTER (task_number = 4), '') AS c4 FROM v_answers GROUP BY 1)
SELECT a.doc_id, a.task_number,
  {_sql_fill(P.GRADING.replace("{others}{metrics}", P.GRADING_OTHERS + P.GRADING_METRICS), task_number="a.task_number", text="left(content, 500)", similarity_ref="printf('%.1f%%', round(sim * 100, 1))", max_similarity="printf('%.1f%%', round(sim * 100, 1))", likelihood="'25.0%'", readability="'61.5'")} AS grading,
  {_sql_fill(P.LOGIC, text="left(content, 500)")} AS logic,
  {_sql_fill(P.ORIGINALITY, text="left(content, 500)", max_similarity="printf('%.1f%%', round(sim * 100, 1))")} AS originality,
  CASE WHEN length(trim(content, <CHARS>)) >= 20 THEN {_sql_fill(P.TAILS, task_number="a.task_number", text="left(content, 1000)", others="array_to_string(list_transform(list_filter([1, 2, 3, 4], lambda n: n <> a.task_number), lambda n: concat('Задание ', n, ':', chr(10), left([c1, c2, c3, c4][n], 200), '...')), chr(10))")} END AS tails
FROM a JOIN p ON p.doc_id = a.doc_id""", ("v_answers",))
def build_prompts(spark, sf):
    answers = v_answers(spark, sf)
    sim, n, c = (F.col("doc_id") % 10) / F.lit(10.0), F.col("task_number"), F.col("content")
    tails = R.tail_prompts(A.pack(answers)).withColumnRenamed("prompt", "tails")
    return answers.select(
        "doc_id", "task_number", R.grading_prompt(n, c, sim, sim, F.lit(0.25), F.lit(61.5)).alias("grading"),
        R.logic_prompt(c).alias("logic"), R.originality_prompt(c, sim).alias("originality"),
    ).join(tails, ["doc_id", "task_number"], "left")


@query("impression_prompts", "P7b", f"""
WITH rows AS (SELECT doc_id, task_number, concat('Задание ', task_number, ':', chr(10), CASE WHEN content <> '' THEN concat('Ответ: ', left(content, 300), chr(10)) ELSE '' END,
    coalesce('Оценка: ' || CAST(final_score AS VARCHAR) || chr(10), ''), 'Комментарий: ', left(CASE WHEN final_score IS NULL THEN {q(K.GRADE_NONE)}
      {" ".join(f"WHEN final_score >= {low} THEN {q(text)}" for low, text in K.GRADE_BANDS)} ELSE {q(K.GRADE_LOW)} END, 200), chr(10), chr(10)) AS b,
    coalesce('- task_' || task_number || ': ' || printf('%.1f%%', CAST(round(CAST(CAST(chosen_sim * 100 AS VARCHAR) AS DECIMAL(38, 18)), 1) AS DOUBLE)) || chr(10), '') AS line FROM v_eval),
docs AS (SELECT doc_id, string_agg(b, '' ORDER BY task_number) AS b, string_agg(line, '' ORDER BY task_number) AS sims FROM rows GROUP BY 1)
SELECT doc_id, concat({q(P.IMPRESSION_HEAD)}, b, CASE WHEN sims <> '' THEN concat('Схожесть с эталоном:', chr(10), sims) ELSE '' END, 'Вероятность использования LLM: 25.0%', chr(10),
  {q(P.IMPRESSION_TAIL)}, CASE WHEN doc_id % 5 = 0 THEN {q(P.IMPRESSION_WINNER)} ELSE '' END, {q(P.IMPRESSION_FORMAT)}) AS prompt FROM docs""", EVAL)
def impression_prompts(spark, sf):
    graded = evaluation(spark, sf).select(
        "doc_id", "task_number", "content", F.col("final_score").alias("score"), "comment", F.col("chosen_sim").alias("similarity")
    )
    return R.impression_prompts(graded, F.col("doc_id") % 5 == 0, F.lit(0.25))


@query("summary_prompts", "P7c", f"""
WITH {ORGANIZER_SQL},
t AS (SELECT doc_id, regexp_replace(regexp_replace(trim(report, <CHARS>), '[ \\t]+', ' ', 'g'), '\\n{{4,}}', concat(chr(10), chr(10), chr(10)), 'g') AS t FROM organizer)
SELECT doc_id, {_sql_fill(P.HR_SUMMARY, report="t")} AS hr, {_sql_fill(P.CANDIDATE_SUMMARY, report="t")} AS candidate FROM t""", EVAL)
def summary_prompts(spark, sf):
    report = R.organizer_report(answered(spark, sf), evaluation(spark, sf), F.lit(TIME))
    return report.select(
        "doc_id", R.summary_prompt(F.col("report"), "hr").alias("hr"), R.summary_prompt(F.col("report"), "candidate").alias("candidate")
    )


@query("submission_report", "P8", f"""
SELECT s.doc_id, s.filename, s.processing_status, p.task_1, p.task_2, p.task_3, p.task_4, t.other_id, t.overall, i.average_llm_likelihood, i.content_llm_likelihood, i.answers_analyzed,
  coalesce(trim(p.task_1, <CHARS>) = '', true) OR coalesce(trim(p.task_2, <CHARS>) = '', true) OR coalesce(trim(p.task_3, <CHARS>) = '', true) OR coalesce(trim(p.task_4, <CHARS>) = '', true) AS has_parsing_problems,
  s.doc_id IN (SELECT user_id FROM events WHERE event_type = 'error') AS has_any_images
FROM v_submissions s
LEFT JOIN (SELECT doc_id, {", ".join(f"max(content) FILTER (task_number = {k}) AS task_{k}" for k in (1, 2, 3, 4))} FROM v_answers GROUP BY 1) p ON p.doc_id = s.doc_id
LEFT JOIN (SELECT doc_id, other_id, round(overall_similarity, 6) AS overall FROM v_pairs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overall_similarity DESC, other_id) = 1) t ON t.doc_id = s.doc_id
LEFT JOIN ({ANALYZED_SQL}) i ON i.doc_id = s.doc_id""", ("v_submissions", "v_answers", "v_marked", "v_vectors", "v_pairs"))
def submission_report(spark, sf):
    answers = v_answers(spark, sf)
    top = similarity.top_similar(v_vectors(spark, sf), k=1).select("doc_id", "other_id", F.round("overall_similarity", 6).alias("overall"))
    checked = integrity.analyze_submission(answers, v_marked(spark, sf))
    checked = checked.withColumns({c: F.round(c, 4) for c in ("average_llm_likelihood", "content_llm_likelihood")})
    images = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("doc_id"))
    record = R.submission_report(documents(spark, sf), A.pack(answers), top, checked, images)
    return record.select(
        "doc_id", "filename", "processing_status", "tasks.*", "similarity_with_existing.*", "integrity.*", "has_parsing_problems", "has_any_images"
    )


@query("metrics_summary", "P9", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN printf('%.1f%%', round(llm_likelihood * 100, 1)) ELSE printf('%.1f%%', round((doc_id % 10) / 10.0 * 100, 1)) END AS likelihood_pct,
  concat(CASE WHEN doc_id % 5 = 0 THEN '' ELSE printf('LLM вероятность: %.1f%%, ', round((doc_id % 10) / 10.0 * 100, 1)) END,
    printf('Читаемость: %.1f', round(readability, 1)), ', Прилагательных: 0, Наречий: 0, Ошибки пунктуации: ', total_errors) AS metrics FROM v_metrics""", ("v_styled", "v_metrics"))
def metrics_summary(spark, sf):
    m = v_styled(spark, sf).select("doc_id", style.analyze_text("content").alias("m"))
    average = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 10) / F.lit(10.0))
    share, text = R.metrics_summary(
        average, F.col("m.llm_likelihood"), F.col("m.readability"), F.col("m.adjectives_count"), F.col("m.adverbs_count"),
        F.col("m.punctuation_errors.total_errors"),
    )
    return m.select("doc_id", share.alias("likelihood_pct"), text.alias("metrics"))
