"""The SQL function surface, used through spark.sql."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwell.functions.registry import EMBEDDERS, likelihood_scorer
from markwell.functions.sqlfuncs import register_functions
from markwell.plans.catalog import query
from markwell.plans.views import table, v_answers, v_styled, v_submissions, v_variants
from markwell.sources.files import decode_files


@query("register_functions", "U1", """
SELECT doc_id, round(readability, 4) AS readability, round(llm_likelihood, 4) AS llm_likelihood,
       regexp_matches(trim(regexp_replace(lower(content), '[<SP>]+', ' ', 'g')), '(^|[^<WD>])the($|[^<WD>])') AS has_the FROM v_metrics""", ("v_styled", "v_metrics"))
def sql_functions(spark, sf):
    register_functions(spark)
    v_styled(spark, sf).createOrReplaceTempView("markwell_styled")
    return spark.sql(
        "SELECT doc_id, round(readability(content), 4) AS readability, round(llm_likelihood(content), 4) AS llm_likelihood,"
        " keyword_hit(content, 'the') AS has_the FROM markwell_styled"
    )


@query("embedder_registry", "U2", """
SELECT doc_id, task_number, CAST(list_sum(vec) AS BIGINT) AS words FROM v_hashed""", ("v_answers", "v_hashed"))
def embedder_registry(spark, sf):
    vec = EMBEDDERS.get("Hashed_Words")(F.col("content"))
    total = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x).cast("bigint")
    return v_answers(spark, sf).select("doc_id", "task_number", total.alias("words"))


@query("vector_functions", "U1b", """
SELECT vec_id, 1.0::DOUBLE AS self_cosine, round(list_dot_product(v, v), 6) AS squared, 1.0::DOUBLE AS unit FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def vector_functions(spark, sf):
    register_functions(spark)
    table(spark, sf, "embeddings").selectExpr("vec_id", "CAST(embedding AS array<double>) AS v").createOrReplaceTempView("markwell_vec")
    return spark.sql(
        "SELECT vec_id, round(cosine(v, v), 6) AS self_cosine, round(aggregate(v, 0D, (s, x) -> s + x * x), 6) AS squared,"
        " round(aggregate(l2_normalize(v), 0D, (s, x) -> s + x * x), 6) AS unit FROM markwell_vec"
    )


@query("segment_udtf", "U4", "SELECT doc_id, task_number, trim(content, <CHARS>) AS content FROM v_answers", ("v_answers",))
def segment_udtf(spark, sf):
    """All marker styles, in SQL alone."""
    register_functions(spark)
    v_variants(spark, sf).createOrReplaceTempView("markwell_variants")
    return spark.sql("SELECT m.doc_id, s.task_number, s.content FROM markwell_variants m, LATERAL segment_text(m.content) s WHERE s.content <> ''")


@query("decoder_registry", "U3", """
SELECT doc_id, CASE WHEN type = 'xls' THEN NULL ELSE content END AS content, CASE WHEN type = 'xls' THEN 'Unsupported file type: xls' END AS error FROM v_submissions""", ("v_submissions",))
def decoder_registry(spark, sf):
    files = v_submissions(spark, sf).select("doc_id", "type", F.encode("content", "UTF-8").alias("content"))
    return decode_files(files).select("doc_id", "content", "error")


@query("likelihood_registry", "U5", """
SELECT doc_id, round(llm_likelihood, 4) AS likelihood FROM v_metrics""", ("v_styled", "v_metrics"))
def likelihood_registry(spark, sf):
    score = likelihood_scorer(None)
    return v_styled(spark, sf).select("doc_id", F.round(score(F.col("content")), 4).alias("likelihood"))
