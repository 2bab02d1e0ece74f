"""Criteria, scores, grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwell.functions import scoring as S
from markwell.functions import style
from markwell.functions import text as T
from markwell.functions.vectors import cosine
from markwell.operators import criteria as C
from markwell.operators import grading as G
from markwell.operators import ranking, similarity
from markwell.plans import fixtures as X
from markwell.plans.catalog import query
from markwell.plans.views import key_set_of, table, texts, v_answers, v_keys, v_styled, v_submissions, v_vectors
from markwell.session import broadcast_if_small

CRITERIA = ("v_answers", "v_catalogue", "v_criteria")
EVAL = ("v_answers", "v_keys", "v_catalogue", "v_criteria", "v_hashed", "v_hashed_keys", "v_eval")
STYLED = ("v_styled", "v_metrics")


def evaluation(spark, sf):
    return G.evaluate_answers(v_answers(spark, sf), v_keys(spark, sf), X.CATALOGUE, key_set=key_set_of(spark, sf))


@query("criteria_match", "G1", """
SELECT doc_id, task_number, criterion_no, name, inverted, matched, matched_keywords, passed FROM v_criteria""", CRITERIA)
def criteria_match(spark, sf):
    out = C.criteria_match(v_answers(spark, sf), X.CATALOGUE)
    return out.withColumn("matched_keywords", F.array_join("matched_keywords", ", "))


@query("criteria_score", "G2", """
SELECT doc_id, task_number, CAST(count(*) FILTER (passed) AS INT) AS passed_count, CAST(count(*) FILTER (NOT passed) AS INT) AS failed_count,
       round(1.0 + 9.0 * count(*) FILTER (passed) / CAST(count(*) AS DOUBLE), 4) AS criteria_score FROM v_criteria GROUP BY ALL""", CRITERIA)
def criteria_score(spark, sf):
    scored = C.with_criteria(v_answers(spark, sf), X.CATALOGUE).filter(F.col("task_number").isin(*X.CATALOGUE))
    return scored.select(
        "doc_id", "task_number", F.col("criteria_passed").alias("passed_count"),
        (F.col("criteria_total") - F.col("criteria_passed")).alias("failed_count"),
        F.round(S.criteria_to_score("criteria_passed", "criteria_total"), 4).alias("criteria_score"),
    )


PAIRS_SQL = """
SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 4) AS sim
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a
JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1"""


def neighbour_pairs(spark, sf):
    """Each vector with its successor: an equi join, no all-pairs."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine("v", "w"), 4).alias("sim"))


@query("cosine_to_score", "G3", f"""
SELECT vec_id, sim, round(greatest(1.0, least(10.0, 10.0 * greatest(0.0, least(1.0, (sim - 0.45::DOUBLE) / (0.90::DOUBLE - 0.45::DOUBLE))))), 1) AS score,
       round(greatest(1.0, least(10.0, 10.0 * greatest(0.0, least(1.0, (sim + 0.2::DOUBLE) / (0.3::DOUBLE + 0.2::DOUBLE))))), 1) AS custom_score
FROM ({PAIRS_SQL})""")
def cosine_to_score(spark, sf):
    return neighbour_pairs(spark, sf).select(
        "vec_id", "sim", S.cosine_to_score("sim").alias("score"), S.cosine_to_score("sim", -0.2, 0.3).alias("custom_score")
    )


@query("score_variant_b", "G4", f"""
SELECT vec_id, round(1.0 + 9.0 * (sim + 1.0) / 2.0, 6) AS cosine_1_10,
       round(0.7 * (1.0 + 9.0 * (sim + 1.0) / 2.0) + 0.3 * (1.0 + 9.0 * (vec_id % 5) / 4.0), 7) AS final_1_10 FROM ({PAIRS_SQL})""")
def score_variant_b(spark, sf):
    ratio = S.criteria_to_score(F.col("vec_id") % 5, F.lit(4))
    return neighbour_pairs(spark, sf).select(
        "vec_id", F.round(S.full_range_cosine_score("sim"), 6).alias("cosine_1_10"),
        F.round(S.variant_b_score("sim", ratio), 7).alias("final_1_10"),
    )


@query("blend_score", "G5", """
SELECT doc_id, task_number, cosine_score, criteria_score, blended_score FROM v_eval""", EVAL)
def blend_score(spark, sf):
    return evaluation(spark, sf).select("doc_id", "task_number", "cosine_score", "criteria_score", "blended_score")


@query("length_adjustment", "G6", """
SELECT doc_id, task_number, answer_len, key_len, round(ratio, 3) AS ratio,
  CASE WHEN ratio IS NULL THEN 0.0 WHEN ratio < 1 THEN round(-1.5 * (1.0 - ratio), 2)
       ELSE round(0.5::DOUBLE * greatest(0.0, least(1.0, (ratio - 1.0) / 0.8::DOUBLE)), 2) END AS delta_score
FROM (SELECT *, CASE WHEN answer_len > 0 AND key_len > 0 THEN (answer_len + 30) / CAST(key_len + 30 AS DOUBLE) END AS ratio
 FROM (SELECT a.doc_id, a.task_number, length(trim(a.content, <CHARS>)) AS answer_len, length(trim(coalesce(k.content, ''), <CHARS>)) AS key_len
       FROM (SELECT *, doc_id % (SELECT max(n_sets) FROM v_keys) AS key_set FROM v_answers) a
       LEFT JOIN v_keys k ON k.task_number = a.task_number AND k.kind = 'ai' AND k.key_set = a.key_set))""", ("v_answers", "v_keys"))
def length_adjustment(spark, sf):
    keys = v_keys(spark, sf).filter("kind = 'ai'").select("key_set", "task_number", F.col("content").alias("key"))
    answers = v_answers(spark, sf).withColumn("key_set", key_set_of(spark, sf))
    joined = answers.join(broadcast_if_small(keys), ["key_set", "task_number"], "left").select(
        "doc_id", "task_number", S.stripped_length("content").alias("answer_len"), S.stripped_length("key").alias("key_len")
    )
    return joined.withColumn("r", S.length_ratio("answer_len", "key_len")).select(
        "doc_id", "task_number", "answer_len", "key_len", S.round_half("r", 3).alias("ratio"), S.length_delta("r").alias("delta_score")
    )


NORM = "trim(regexp_replace(lower(text), '[^<WD>]+', ' ', 'g'))"
HITS = X.count_patterns("n", [(p,) for p in X.UNCERTAINTY])
COVER = X.count_patterns("n", X.CONCRETENESS.values())


@query("uncertainty_hits", "G7", f"SELECT doc_id, {HITS} AS hits FROM (SELECT doc_id, {NORM} AS n FROM documents)")
def uncertainty_hits(spark, sf):
    n = texts(spark, sf).select("doc_id", T.normalize_strip_punct("text").alias("n"))
    return n.select("doc_id", S.uncertainty_hits("n", X.UNCERTAINTY).alias("hits"))


@query("concreteness_coverage", "G8", f"SELECT doc_id, {COVER} AS coverage FROM (SELECT doc_id, {NORM} AS n FROM documents)")
def concreteness_coverage(spark, sf):
    n = texts(spark, sf).select("doc_id", T.normalize_strip_punct("text").alias("n"))
    return n.select("doc_id", S.concreteness_coverage("n", X.CONCRETENESS).alias("coverage"))


@query("quality_penalties", "G9", f"""
SELECT doc_id, round(greatest(1.0, least(10.0, base - 0.7 * least(hits, 3) - CASE WHEN coverage = 0 AND n <> '' THEN 1.0 ELSE 0.0 END)), 1) AS score
FROM (SELECT doc_id, n, (n_chars % 101) / 10.0::DOUBLE AS base, {HITS} AS hits, {COVER} AS coverage
      FROM (SELECT doc_id, n_chars, {NORM} AS n FROM documents))""")
def quality_penalties(spark, sf):
    n = texts(spark, sf).select("doc_id", "n_chars", T.normalize_strip_punct("text").alias("n"))
    base = (F.col("n_chars") % 101) / F.lit(10.0)
    return n.select(
        "doc_id",
        S.quality_penalties(
            base, S.uncertainty_hits("n", X.UNCERTAINTY), S.concreteness_coverage("n", X.CONCRETENESS), F.length("n")
        ).alias("score"),
    )


@query("grade_band", "G10", """
SELECT doc_id, average_score, CASE WHEN average_score >= 8.5 THEN 'Ответ полностью соответствует эталону: точная аргументация, корректные термины, логичная структура.'
 WHEN average_score >= 6 THEN 'Ответ в целом соответствует эталону, но есть небольшие упущения или неточности в деталях.'
 WHEN average_score >= 4 THEN 'Частичное соответствие: основные идеи верны, но много неточностей или пропущены ключевые моменты.'
 ELSE 'Низкое соответствие: ответ содержит существенные ошибки, пропуски или нелогичные рассуждения.' END AS comment FROM v_submissions""", ("v_submissions",))
def grade_band(spark, sf):
    return v_submissions(spark, sf).select("doc_id", "average_score", S.grade_band("average_score").alias("comment"))


@query("evaluate_answers", "G11", """
SELECT doc_id, task_number, hr_sim, ai_sim, chosen, CAST(criteria_passed AS INT) AS criteria_passed, CAST(criteria_total AS INT) AS criteria_total,
       criteria_score, cosine_score, blended_score, answer_len, ai_key_len, length_ratio, length_delta, final_score,
       CASE WHEN content = '' THEN concat('Вопрос ', task_number, ': у кандидата нет ответа или пусто.') END AS warning FROM v_eval""", EVAL)
def evaluate_answers(spark, sf):
    return evaluation(spark, sf).select(
        "doc_id", "task_number", "hr_sim", "ai_sim", "chosen", "criteria_passed", "criteria_total", "criteria_score",
        "cosine_score", "blended_score", "answer_len", "ai_key_len", "length_ratio", "length_delta", "final_score", "warning",
    )


QUALITY_SQL = """
CASE WHEN length(trim(content, <CHARS>)) < 10 THEN 0.0 ELSE least(3.0,
  (CASE WHEN readability >= 50 THEN least(1.5, (readability - 50) / 30 * 1.5) ELSE readability / 50 * 1.5 END) +
  CASE WHEN total_words = 0 THEN 0.0 WHEN wps BETWEEN 10 AND 20 THEN 1.5 WHEN (wps >= 5 AND wps < 10) OR (wps > 20 AND wps <= 30) THEN 1.0 ELSE 0.5 END) END"""
ANTI_SQL = """
greatest(0.0, least(2.0, (1.0 - llm_likelihood) * 2.0 + CASE WHEN total_errors = 0 THEN 0.2 WHEN total_errors <= 2 THEN 0.1 ELSE 0.0 END))"""
METRICS_SQL = """
(SELECT *, total_words / CAST(greatest(1, len(regexp_extract_all(content, '[.!?]'))) AS DOUBLE) AS wps FROM v_metrics)"""


def scored_texts(spark, sf):
    m = v_styled(spark, sf).select("doc_id", "content", style.analyze_text("content").alias("m"))
    return m.select(
        "doc_id", "content", "m.readability", "m.llm_likelihood", "m.punctuation_errors.total_errors"
    )


@query("auto_task_score", "G12", f"""
SELECT doc_id, round(greatest(0.0, least(10.0, (doc_id % 11) / 10.0 * 10 * 0.5 + {QUALITY_SQL} + {ANTI_SQL})), 4) AS score FROM {METRICS_SQL}""", STYLED)
def auto_task_score(spark, sf):
    sim = (F.col("doc_id") % 11) / F.lit(10.0)
    score = S.auto_task_score(
        sim, S.quality_score("content", "readability"), S.anti_cheating_score("llm_likelihood", "total_errors")
    )
    return scored_texts(spark, sf).select("doc_id", F.round(score, 4).alias("score"))


@query("quality_score", "G13", f"SELECT doc_id, round({QUALITY_SQL}, 4) AS quality FROM {METRICS_SQL}", STYLED)
def quality_score(spark, sf):
    return scored_texts(spark, sf).select("doc_id", F.round(S.quality_score("content", "readability"), 4).alias("quality"))


@query("anti_cheating_score", "G14", f"SELECT doc_id, round({ANTI_SQL}, 4) AS anti_cheating FROM {METRICS_SQL}", STYLED)
def anti_cheating_score(spark, sf):
    return scored_texts(spark, sf).select(
        "doc_id", F.round(S.anti_cheating_score("llm_likelihood", "total_errors"), 4).alias("anti_cheating")
    )


@query("average_score", "G15", """
SELECT doc_id, round(avg(CASE WHEN task_number <= 3 THEN final_score END), 2) AS average_score_tasks_1_3 FROM v_eval GROUP BY doc_id""", EVAL)
def average_score(spark, sf):
    return G.average_score(evaluation(spark, sf))


def answer_likelihood(spark, sf):
    sim = (F.col("doc_id") % 7) / F.lit(7.0)
    return v_answers(spark, sf).select(
        "doc_id", "task_number", "content", sim.alias("sim"), F.lit(0.25).alias("likelihood")
    )


@query("logic_score", "G16", """
SELECT doc_id, task_number, round(greatest(0.0, least(100.0, 50.0 + (doc_id % 7) / 7.0 * 30
   + CASE WHEN n >= 3 THEN 10 WHEN n >= 1 THEN 5 ELSE 0 END - 0.25 * 20)), 4) AS logic_score
FROM (SELECT *, len(regexp_extract_all(content, '[.!?]')) AS n FROM v_answers)""", ("v_answers",))
def logic_score(spark, sf):
    return answer_likelihood(spark, sf).select(
        "doc_id", "task_number", F.round(S.logic_score("content", "sim", "likelihood"), 4).alias("logic_score")
    )


@query("originality_score", "G17", """
WITH u AS (SELECT doc_id, slot, vec FROM v_vectors),
s AS (SELECT a.doc_id, b.doc_id AS other, a.slot, list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)) AS sim
      FROM u a JOIN u b ON a.slot = b.slot AND a.doc_id <> b.doc_id),
o AS (SELECT doc_id, other, (coalesce(avg(sim) FILTER (slot > 0), 0) + coalesce(max(sim) FILTER (slot = 0), 0)) / 2 AS overall FROM s GROUP BY ALL)
SELECT doc_id, round(greatest(0.0, least(100.0, (1.0 - greatest(0.0, max(overall))) * 100 - 20 * (doc_id % 5) / 10.0)), 3) AS originality FROM o GROUP BY doc_id""", ("v_vectors",))
def originality_score(spark, sf):
    best = similarity.top_similar(v_vectors(spark, sf), k=1)
    likelihood = (F.col("doc_id") % 5) / F.lit(10.0)
    return best.select("doc_id", F.round(S.originality_score("overall_similarity", likelihood), 3).alias("originality"))


@query("apply_manual_grades", "G18", """
WITH base AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE average_score END AS task_1_score, average_score / 2 AS task_2_score,
                     CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 11)::DOUBLE END AS task_3_score, 40.0 AS task_4_logic_score FROM v_submissions),
e AS (SELECT s.doc_id, CAST(s.doc_id % 4 + 1 AS INT) AS task, CAST(l.quality * 8 + l.toxic * 4 AS DOUBLE) AS score FROM v_submissions s JOIN labels l ON l.doc_id = s.doc_id),
ok AS (SELECT * FROM e WHERE task = 4 OR score <= 10),
m AS (SELECT b.doc_id, CASE WHEN o.task = 1 THEN o.score ELSE b.task_1_score END AS task_1_score, CASE WHEN o.task = 2 THEN o.score ELSE b.task_2_score END AS task_2_score,
  CASE WHEN o.task = 3 THEN o.score ELSE b.task_3_score END AS task_3_score, CASE WHEN o.task = 4 THEN o.score ELSE b.task_4_logic_score END AS task_4_logic_score,
  coalesce(o.task < 4, false) AS touched FROM base b LEFT JOIN ok o ON o.doc_id = b.doc_id)
SELECT doc_id, round(task_1_score, 6) AS task_1_score, round(task_2_score, 6) AS task_2_score, round(task_3_score, 6) AS task_3_score, round(task_4_logic_score, 6) AS task_4_logic_score,
  round(CASE WHEN touched THEN list_avg(list_filter([task_1_score, task_2_score, task_3_score], lambda x: x IS NOT NULL)) ELSE 5.0 END, 6) AS average_score_tasks_1_3 FROM m""", ("v_submissions",))
def apply_manual_grades(spark, sf):
    subs = v_submissions(spark, sf)
    d, avg = F.col("doc_id"), F.col("average_score")
    base = subs.select(
        "doc_id", F.when(d % 3 != 0, avg).alias("task_1_score"), (avg / 2).alias("task_2_score"),
        F.when(d % 5 != 0, (d % 11).cast("double")).alias("task_3_score"), F.lit(40.0).alias("task_4_logic_score"),
        F.lit(50.0).alias("task_4_originality_score"), F.lit(5.0).alias("average_score_tasks_1_3"),
    )
    score = (F.col("quality") * 8 + F.col("toxic") * 4).cast("string")
    edits = subs.select("doc_id").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", (d % 4 + 1).cast("int").alias("task_number"), score.alias("score"), score.alias("logic_score"),
        F.lit(None).cast("string").alias("originality_score"), F.lit("").alias("comment"),
    )
    out = G.apply_manual_grades(base, edits)
    cols = ("task_1_score", "task_2_score", "task_3_score", "task_4_logic_score", "average_score_tasks_1_3")
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in cols])


@query("apply_criteria_overrides", "G19", """
SELECT doc_id, task_number, criterion_no, name, CASE WHEN criterion_no = 1 AND doc_id % 3 = 0 THEN true WHEN criterion_no = 2 AND doc_id % 4 = 1 THEN false ELSE passed END AS passed
FROM v_criteria""", CRITERIA)
def apply_criteria_overrides(spark, sf):
    matched = C.criteria_match(v_answers(spark, sf), X.CATALOGUE)
    named = {(q, i): c.name for q, cs in X.CATALOGUE.items() for i, c in enumerate(cs, 1)}
    answers = v_answers(spark, sf).select("doc_id", "task_number")

    def edit(number: int, hit, passed: bool):
        name = F.coalesce(*[F.when(F.col("task_number") == q, n) for (q, i), n in named.items() if i == number])
        return answers.filter(hit).select("doc_id", "task_number", name.alias("name"), F.lit(passed).alias("passed")).filter(
            "name IS NOT NULL"
        )

    d = F.col("doc_id")
    # each override was entered the other way round before
    final = edit(1, d % 3 == 0, True).unionByName(edit(2, d % 4 == 1, False)).withColumn("seq", F.lit(2))
    earlier = final.withColumns({"passed": ~F.col("passed"), "seq": F.lit(1)})
    return C.apply_overrides(matched, final.unionByName(earlier), order="seq").select("doc_id", "task_number", "criterion_no", "name", "passed")


@query("flagship_assessment", "flagship", f"""
WITH scored AS (
  SELECT a.doc_id, a.task_number, p.passed / CAST(p.total AS DOUBLE) AS ratio, length(a.content) AS size
  FROM v_answers a JOIN (SELECT doc_id, task_number, count(*) FILTER (passed) AS passed, count(*) AS total FROM v_criteria GROUP BY ALL) p
    ON p.doc_id = a.doc_id AND p.task_number = a.task_number),
per_doc AS (SELECT doc_id, round(avg(round(1.0 + 9.0 * ratio, 2)), 4) AS criteria_average, count(*) AS answers FROM scored WHERE task_number <= 3 GROUP BY doc_id)
SELECT row_number() OVER (ORDER BY criteria_average DESC, doc_id) AS place, doc_id, criteria_average, answers FROM per_doc
ORDER BY criteria_average DESC, doc_id LIMIT 10""", CRITERIA)
def flagship_assessment(spark, sf):
    """Criteria of every answer, mean per document, the ten best (a top-k report)."""
    scored = C.with_criteria(v_answers(spark, sf), X.CATALOGUE).filter("task_number <= 3")
    per_doc = scored.groupBy("doc_id").agg(
        F.round(F.avg(F.round(S.criteria_to_score("criteria_passed", "criteria_total"), 2)), 4).alias("criteria_average"),
        F.count("*").alias("answers"),
    )
    top = ranking.top_n(per_doc, [F.desc("criteria_average"), F.asc("doc_id")], 10)
    return top.select("place", "doc_id", "criteria_average", "answers")
