"""The full evaluation of answers against two answer keys, and edits of grades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions import scoring as S
from markwell.functions import text as T
from markwell.functions.vectors import cosine, hashed_words
from markwell.operators.criteria import Catalogue, with_criteria
from markwell.session import broadcast_if_small

Embed = Callable[[Column], Column]

# Questions of an answer key, all of which become columns of a plan; more raise an error.
MAX_QUESTIONS = 200


def choose_reference(hr_sim: Column, ai_sim: Column) -> Column:
    """'hr' or 'ai' by the greater similarity, hr on a tie, NULL when both are missing."""
    return (
        F.when(hr_sim.isNull() & ai_sim.isNull(), F.lit(None).cast("string"))
        .when(hr_sim.isNull(), "ai")
        .when(ai_sim.isNull() | (hr_sim >= ai_sim), "hr")
        .otherwise("ai")
    )


def similarity_from_evaluation(chosen: Column, hr_sim: Column, ai_sim: Column) -> Column:
    return F.coalesce(
        F.when(chosen == "hr", hr_sim).when(chosen == "ai", ai_sim), ai_sim, hr_sim
    )


def question_spine(answers: DataFrame, key_questions: list[int]) -> DataFrame:
    """Every document with every key question, plus the questions only the candidate has."""
    wanted = sorted(set(key_questions))
    if not wanted:
        return answers.select("doc_id", "task_number", "content", F.lit(True).alias("has_candidate"))
    known = F.col("task_number").isin(*wanted)
    packed = answers.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("task_number") == q, F.col("content"))).alias(f"q{q}") for q in wanted],
        *[F.max((F.col("task_number") == q).cast("int")).alias(f"has{q}") for q in wanted],
    )
    slots = F.array(
        *[
            F.struct(
                F.lit(q).alias("task_number"), F.col(f"q{q}").alias("content"), (F.col(f"has{q}") == 1).alias("has_candidate")
            )
            for q in wanted
        ]
    )
    extra = answers.filter(~known).select("doc_id", "task_number", "content", F.lit(True).alias("has_candidate"))
    return packed.select("doc_id", F.inline_outer(slots)).unionByName(extra)


def key_table(keys: DataFrame, embed: Embed) -> DataFrame:
    """One row per question (of a key set, if there are several) with the text and vector of both keys."""
    by = [c for c in ("key_set", "task_number") if c in keys.columns]
    wide = keys.groupBy(*by).agg(
        F.max(F.when(F.col("kind") == "hr", F.col("content"))).alias("hr_text"),
        F.max(F.when(F.col("kind") == "ai", F.col("content"))).alias("ai_text"),
    )
    vecs = F.transform(
        F.array("hr_text", "ai_text"), lambda t: F.when(F.length(T.normalize_strip_punct(t)) > 0, embed(t))
    )
    return wide.select(*by, "ai_text", vecs.alias("key_vecs"))


def evaluate_answers(
    answers: DataFrame,
    keys: DataFrame,
    catalogue: Catalogue,
    embed: Embed = hashed_words,
    key_set: Column | None = None,
) -> DataFrame:
    """One row per (document, question) with similarities, criteria, score breakdown, grade and comment.

    The questions are those of the answer key, a configuration table; all of them are kept. If ``keys`` holds several sets
    (column ``key_set``), ``key_set`` says, from ``doc_id``, which of them a document is compared with."""
    questions = [r[0] for r in keys.select("task_number").distinct().limit(MAX_QUESTIONS + 1).collect()]
    if len(questions) > MAX_QUESTIONS:
        raise ValueError(f"an answer key has at most {MAX_QUESTIONS} questions")
    spine = question_spine(answers, questions)
    on = ["task_number"]
    if key_set is not None:
        spine, on = spine.withColumn("key_set", key_set), ["key_set", "task_number"]
    keyed = spine.join(broadcast_if_small(key_table(keys, embed)), on, "left")
    prepared = with_criteria(
        keyed.withColumn("content", F.coalesce("content", F.lit(""))).withColumn(
            "_norm_text", T.normalize_strip_punct("content")
        ),
        catalogue,
    )
    vectors = prepared.withColumn("_vec", F.when(F.length("_norm_text") > 0, embed(F.col("content"))))

    sims = F.transform(
        "key_vecs",
        lambda key: F.when(F.col("_vec").isNotNull() & key.isNotNull(), S.round_half(cosine("_vec", key), 4)),
    )
    compared = vectors.withColumn("_sims", sims).withColumns(
        {"hr_sim": F.get("_sims", F.lit(0)), "ai_sim": F.get("_sims", F.lit(1))}
    ).withColumn(
        "chosen", choose_reference(F.col("hr_sim"), F.col("ai_sim"))
    )
    scored = compared.withColumns(
        {
            "chosen_sim": F.when(F.col("chosen") == "hr", F.col("hr_sim")).when(F.col("chosen") == "ai", F.col("ai_sim")),
            "criteria_score": S.round_half(S.criteria_to_score("criteria_passed", "criteria_total"), 2),
        }
    ).withColumns(
        {
            "criteria_score": F.when(F.col("criteria_total").isNotNull(), F.col("criteria_score")),
            "cosine_score": S.cosine_to_score("chosen_sim"),
            "answer_len": S.stripped_length("content"),
            "ai_key_len": F.when(F.col("chosen").isNotNull(), S.stripped_length("ai_text")).otherwise(0),
        }
    )
    blended = scored.withColumns(
        {
            "_blend": S.blend_score("cosine_score", "criteria_score"),
            "_ratio": S.length_ratio("answer_len", "ai_key_len"),
        }
    ).withColumns(
        {
            "blended_score": S.round_half("_blend", 2),
            "length_ratio": S.round_half("_ratio", 3),
            "length_delta": S.length_delta("_ratio"),
        }
    )
    graded = blended.withColumn(
        "final_score",
        S.quality_penalties(
            F.col("_blend") + F.col("length_delta"),
            S.uncertainty_hits("_norm_text"),
            S.concreteness_coverage("_norm_text"),
            F.length("_norm_text"),
        ),
    )
    return graded.select(
        "doc_id", "task_number", "content", "hr_sim", "ai_sim", "chosen", "chosen_sim", "criteria_details",
        "criteria_passed", "criteria_total", "criteria_score", "cosine_score", "blended_score", "answer_len",
        "ai_key_len", "length_ratio", "length_delta", "final_score",
        S.grade_band("final_score").alias("comment"),
        F.when(
            F.length("content") == 0,
            F.concat(F.lit("Вопрос "), "task_number", F.lit(": у кандидата нет ответа или пусто.")),
        ).alias("warning"),
    )


def average_score(scores: DataFrame, score: str = "final_score") -> DataFrame:
    """Mean of the non-null scores of tasks 1..3 per document, 2 decimals, NULL if there are none."""
    counted = F.when(F.col("task_number") <= 3, F.col(score))
    return scores.groupBy("doc_id").agg(S.round_half(F.avg(counted), 2).alias("average_score_tasks_1_3"))


def validate_grades(edits: DataFrame) -> DataFrame:
    """Split manual grades: adds ``valid`` and ``reason``. Empty values mean 'clear the grade'.

    ``edits``: (doc_id, task_number, score, logic_score, originality_score, comment), scores as text.
    """

    def bad(name: str, upper: int) -> Column:
        given = F.coalesce(F.length(T.strip(name)) > 0, F.lit(False))
        value = F.col(name).try_cast("double")
        return given & ~F.coalesce(value.between(0, upper), F.lit(False))

    task = F.col("task_number")
    reason = (
        F.when(~F.coalesce(task.isin(*K.TASKS), F.lit(False)), "Invalid task number")
        .when((task < 4) & bad("score", 10), "Score must be between 0 and 10")
        .when((task == 4) & bad("logic_score", 100), "Logic score must be between 0 and 100")
        .when((task == 4) & bad("originality_score", 100), "Originality score must be between 0 and 100")
    )
    return edits.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def apply_manual_grades(grades: DataFrame, edits: DataFrame) -> DataFrame:
    """Overlay valid edits on (doc_id, task_1..3_score, task_4_logic_score, task_4_originality_score).

    The average of tasks 1..3 is recomputed for documents with an edited score and kept when no score remains.
    """
    valid = validate_grades(edits).filter("valid")

    def picked(task: int, source: str, name: str) -> list[Column]:
        mine = F.col("task_number") == task
        return [
            F.max(F.when(mine, F.col(source).try_cast("double"))).alias(f"_new_{name}"),
            F.max(mine.cast("int")).alias(f"_set_{name}"),
        ]

    names = {f"task_{k}_score": (k, "score") for k in (1, 2, 3)}
    names |= {"task_4_logic_score": (4, "logic_score"), "task_4_originality_score": (4, "originality_score")}
    changes = valid.groupBy("doc_id").agg(*[c for n, (k, src) in names.items() for c in picked(k, src, n)])
    merged = grades.join(changes, "doc_id", "left")
    updated = merged.withColumns(
        {n: F.when(F.col(f"_set_{n}") == 1, F.col(f"_new_{n}")).otherwise(F.col(n)) for n in names}
    )
    three = F.filter(F.array("task_1_score", "task_2_score", "task_3_score"), lambda s: s.isNotNull())
    mean = F.try_divide(F.aggregate(three, F.lit(0.0), lambda a, s: a + s), F.size(three))
    touched = (F.col("_set_task_1_score") == 1) | (F.col("_set_task_2_score") == 1) | (F.col("_set_task_3_score") == 1)
    averaged = updated.withColumn(
        "average_score_tasks_1_3",
        F.when(F.coalesce(touched, F.lit(False)), F.coalesce(mean, F.col("average_score_tasks_1_3"))).otherwise(
            F.col("average_score_tasks_1_3")
        ),
    )
    return averaged.select(*grades.columns)
