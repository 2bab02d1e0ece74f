"""Find fragments that belong to another answer of the same document and move them there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions import text as T
from markwell.functions.text import let
from markwell.functions.vectors import cosine_of, hashed_words, squared_norm
from markwell.operators.answers import cleaning_status, non_empty_count, pack, slot_names, unpack

TAIL = "struct<text:string,belongs_to_task:int,similarity:double>"
Embed = Callable[[Column], Column]


def fragments(text: Column) -> Column:
    """Paragraphs, or sentences when there are fewer than two paragraphs; short ones dropped."""
    paragraphs = T.split_paragraphs(text)
    parts = F.when(F.size(paragraphs) >= 2, paragraphs).otherwise(T.split_sentences(text))
    long_parts = F.filter(parts, lambda p: F.length(p) >= K.TAIL_MIN_CHARS)
    return F.when(T.is_blank(text) | (F.length(T.strip(text)) < K.TAIL_MIN_CHARS), F.array().cast("array<string>")).otherwise(
        long_parts
    )


def with_tails(
    packed: DataFrame, embed: Embed = hashed_words, threshold: float = K.TAIL_SIMILARITY,
    require_better_than_own: bool = False,
) -> DataFrame:
    """Add tails_1..tails_4 to one-row-per-document answers; everything stays inside the row."""
    texts = packed.withColumn("_texts", F.array(*[F.coalesce(F.col(c), F.lit("")) for c in slot_names()]))

    def measured(text: Column) -> Column:
        return let(embed(text), lambda v: F.struct(text.alias("text"), v.alias("vec"), squared_norm(v).alias("square")))

    vectors = texts.withColumn("_vecs", F.transform("_texts", lambda t: measured(t)))
    parts = vectors.withColumn(
        "_parts",
        F.transform("_texts", lambda t: F.transform(fragments(t), lambda p: measured(p))),
    )

    def near(part, o) -> Column:
        other = F.get("_vecs", o)
        return cosine_of(part["vec"], other["vec"], part["square"], other["square"])

    def judge(part, i):
        others = F.filter(F.sequence(F.lit(0), F.lit(len(K.TASKS) - 1)), lambda o: o != i)
        options = F.transform(
            others,
            lambda o: F.struct(near(part, o).alias("similarity"), (-o - 1).alias("minus_task")),
        )
        own = near(part, i) if require_better_than_own else F.lit(-1.0)
        return let(
            F.array_max(options),
            lambda best: F.struct(
                part["text"].alias("text"), (-best["minus_task"]).alias("belongs_to_task"),
                best["similarity"].alias("similarity"), (best["similarity"] > own).alias("foreign"),
            ),
        )

    judged = parts.withColumn("_judged", F.transform("_parts", lambda ps, i: F.transform(ps, lambda p: judge(p, i))))
    kept = judged.withColumn(
        "_tails",
        F.transform(
            "_judged",
            lambda ts: F.transform(
                F.filter(ts, lambda t: (t["similarity"] > threshold) & t["foreign"]),
                lambda t: F.struct(t["text"].alias("text"), t["belongs_to_task"].alias("belongs_to_task"),
                                   t["similarity"].alias("similarity")),
            ),
        ),
    )
    return kept.select(*packed.columns, *[F.get("_tails", F.lit(k - 1)).alias(f"tails_{k}") for k in K.TASKS])


def detect_tails(answers: DataFrame, embed: Embed = hashed_words, threshold: float = K.TAIL_SIMILARITY) -> DataFrame:
    """(doc_id, task_number, tail_no, text, belongs_to_task, similarity)."""
    slots = F.array(
        *[F.struct(F.lit(k).alias("task_number"), F.col(f"tails_{k}").alias("tails")) for k in K.TASKS]
    )
    return (
        with_tails(pack(answers), embed, threshold)
        .select("doc_id", F.inline_outer(slots))
        .select("doc_id", "task_number", F.posexplode("tails").alias("tail_no", "t"))
        .select("doc_id", "task_number", "tail_no", "t.*")
    )


def merge_tail_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """All tails of ``first`` plus those of ``second`` whose text the task does not have yet."""
    keys = ["doc_id", "task_number", "text"]
    fresh = second.join(first.select(*keys), keys, "left_anti")
    return first.withColumn("source_no", F.lit(1)).unionByName(fresh.withColumn("source_no", F.lit(2)))


def _texts_for(tails: Column, task: int) -> Column:
    return F.transform(F.filter(tails, lambda t: t["belongs_to_task"] == task), lambda t: t["text"])


def _moved(packed_with_tails: DataFrame) -> DataFrame:
    cleaned = [
        F.aggregate(
            F.col(f"tails_{k}"), F.coalesce(F.col(f"task_{k}"), F.lit("")),
            lambda text, tail: T.strip(F.replace(text, tail["text"], F.lit(""))),
        ).alias(f"task_{k}")
        for k in K.TASKS
    ]
    all_tails = F.concat(*[F.col(f"tails_{k}") for k in K.TASKS])
    received = [_texts_for(all_tails, k).alias(f"task_{k}_tails") for k in K.TASKS]
    return packed_with_tails.select("doc_id", *cleaned, *received, F.size(all_tails).alias("tails_detected"))


def redistribute_tails(answers: DataFrame, tails: DataFrame) -> DataFrame:
    """Cut each tail out of its source answer and list it under its target task.

    ``tails`` come from the fragments of one answer, so the per-answer lists are no larger than the answer.
    """
    lists = tails.groupBy("doc_id").agg(
        *[
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.when(F.col("task_number") == k, F.struct("tail_no", "text", "belongs_to_task", "similarity"))
                    )
                ),
                lambda t: F.struct(t["text"].alias("text"), t["belongs_to_task"].alias("belongs_to_task"),
                                   t["similarity"].alias("similarity")),
            ).alias(f"tails_{k}")
            for k in K.TASKS
        ]
    )
    empty = F.array().cast(f"array<{TAIL}>")
    joined = pack(answers).join(lists, "doc_id", "left").select(
        "doc_id", *slot_names(), *[F.coalesce(F.col(f"tails_{k}"), empty).alias(f"tails_{k}") for k in K.TASKS]
    )
    return _moved(joined)


def clean_tasks(answers: DataFrame, embed: Embed = hashed_words, threshold: float = K.TAIL_SIMILARITY) -> DataFrame:
    """Detect, move and count: one shuffle to bring the four answers together, the rest row-local."""
    moved = _moved(with_tails(pack(answers), embed, threshold))
    counted = moved.withColumn("tasks_count", non_empty_count([F.col(c) for c in slot_names()]))
    return counted.withColumn("cleaning_status", cleaning_status(F.col("tasks_count")))


def tail_lists(cleaned: DataFrame) -> DataFrame:
    slots = F.array(
        *[
            F.struct(
                F.lit(k).alias("task_number"), F.col(f"task_{k}").alias("content"), F.col(f"task_{k}_tails").alias("tails")
            )
            for k in K.TASKS
        ]
    )
    return cleaned.select("doc_id", F.inline_outer(slots))


__all__ = [
    "clean_tasks", "detect_tails", "fragments", "merge_tail_sets", "redistribute_tails", "tail_lists", "unpack", "with_tails",
]
