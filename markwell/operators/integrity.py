"""Style metrics per answer and per submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwell.functions import style
from markwell.functions import text as T


def analyze_answers(answers: DataFrame) -> DataFrame:
    """Add the ``metrics`` struct to every non-blank answer."""
    return answers.filter(~T.is_blank("content")).withColumn("metrics", style.analyze_text("content"))


def analyze_submission(answers: DataFrame, contents: DataFrame) -> DataFrame:
    """(doc_id, average_llm_likelihood, content_llm_likelihood, answers_analyzed)."""
    per_doc = (
        answers.filter(~T.is_blank("content"))
        .groupBy("doc_id")
        .agg(F.avg(style.llm_likelihood("content")).alias("_avg"), F.count("*").alias("answers_analyzed"))
    )
    whole = contents.select("doc_id", style.llm_likelihood("content").alias("content_llm_likelihood"))
    return whole.join(per_doc, "doc_id", "left").select(
        "doc_id",
        F.coalesce("_avg", F.lit(0.0)).alias("average_llm_likelihood"),
        "content_llm_likelihood",
        F.coalesce("answers_analyzed", F.lit(0)).alias("answers_analyzed"),
    )
