"""Report texts and report records.

A report joins the lines of at most a handful of questions per document; each question's lines are built in its
row and only then brought together by ``collect_list`` in question order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwell import constants as K
from markwell import prompts as P
from markwell.functions import text as T
from markwell.functions.scoring import round_half

NO_DATA = "Нет данных оценки (eval_v6)."
RULE = "=" * 50
RECOMMENDED = "Рекомендация: кандидат рекомендуется."
NOT_RECOMMENDED = "Рекомендация: кандидат не рекомендуется."


def fixed(value: Column, digits: int) -> Column:
    """The value with a fixed number of decimals, NULL for NULL."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double")))


def percent(value: Column, rounded=F.round) -> Column:
    return F.concat(fixed(rounded(value * 100, 1), 1), F.lit("%"))


def _names(passed: bool) -> Column:
    wanted = (lambda d: d["passed"]) if passed else (lambda d: ~d["passed"])
    details = F.coalesce("criteria_details", F.array().cast("array<struct<name:string,passed:boolean>>"))
    slim = F.transform(details, lambda d: F.struct(d["name"].alias("name"), d["passed"].alias("passed")))
    return F.transform(F.filter(slim, wanted), lambda d: d["name"])


def _with_names(evaluation: DataFrame) -> DataFrame:
    slim = F.transform(
        "criteria_details", lambda d: F.struct(d["name"].alias("name"), d["passed"].alias("passed"))
    )
    return evaluation.withColumn("criteria_details", slim).withColumns(
        {"passed_names": _names(True), "failed_names": _names(False)}
    )


def _joined(names: str, sep: str = ", ") -> Column:
    return F.array_join(names, sep)


def _or_dash(names: str) -> Column:
    return F.when(F.size(names) > 0, _joined(names)).otherwise(F.lit("—"))


def _lines(*parts: Column) -> Column:
    """Join the non-null parts with newlines (an empty string is an empty line)."""
    return F.concat_ws("\n", *parts)


def _blocks(rows: DataFrame, block: Column, counted: Column) -> DataFrame:
    """(doc_id, body, overall, passed, total): question blocks in order and the mean of the counted scores."""
    prepared = rows.select("doc_id", "task_number", "final_score", block.alias("block"), counted.alias("counted"),
                           F.size("passed_names").alias("np"), F.size("failed_names").alias("nf"))
    grouped = prepared.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("task_number", "block"))).alias("blocks"),
        F.round(F.avg(F.when(F.col("counted"), F.col("final_score"))), 2).alias("overall"),
        F.sum(F.when(F.col("counted"), F.col("np")).otherwise(0)).alias("passed"),
        F.sum(F.when(F.col("counted"), F.col("np") + F.col("nf")).otherwise(0)).alias("total"),
    )
    return grouped.withColumn("body", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n")).drop("blocks")


def recommendation(evaluation: DataFrame) -> DataFrame:
    """Recommend with at least half of the criteria of tasks 1..3 passed and a mean score of 6 or more."""
    three = evaluation.filter("task_number <= 3").groupBy("doc_id").agg(
        F.coalesce(F.sum("criteria_passed"), F.lit(0)).alias("passed"),
        F.coalesce(F.sum("criteria_total"), F.lit(0)).alias("total"),
        F.coalesce(F.round(F.avg("final_score"), 2), F.lit(0.0)).alias("overall"),
    )
    ratio = F.coalesce(F.try_divide(F.col("passed"), F.col("total")), F.lit(0.0))
    return three.select("doc_id", F.round(ratio, 4).alias("criteria_ratio"), "overall", ((ratio >= 0.5) & (F.col("overall") >= 6)).alias("recommended"))


def organizer_report(documents: DataFrame, evaluation: DataFrame, report_time: Column) -> DataFrame:
    rows = _with_names(evaluation.filter("task_number <= 3"))
    block = _lines(
        F.concat(F.lit("Задание "), "task_number"),
        F.concat(F.lit("Выполненные критерии: "), _or_dash("passed_names")),
        F.concat(F.lit("Не выполненные критерии: "), _or_dash("failed_names")),
        F.concat(F.lit("Балл: "), F.coalesce(fixed(F.col("final_score"), 1), F.lit("—"))),
        F.lit(""),
    )
    ready = documents.select("doc_id", "filename").join(_blocks(rows, block, F.lit(True)), "doc_id", "left")
    overall, ratio = F.col("overall"), F.try_divide(F.col("passed"), F.col("total"))
    good = (F.coalesce(ratio, F.lit(0.0)) >= 0.5) & (F.coalesce(overall, F.lit(0.0)) >= 6)
    summary = F.concat(
        F.lit("Итоговый балл (среднее за задания 1–3): "), F.coalesce(fixed(overall, 2), F.lit("нет данных"))
    )
    full = _lines(F.col("body"), summary, F.when(good, RECOMMENDED).otherwise(NOT_RECOMMENDED))
    text = _lines(
        _candidate_line(), F.concat(F.lit("Дата: "), report_time), F.lit(""),
        F.when(F.col("body").isNull(), NO_DATA).otherwise(full),
    )
    return ready.select("doc_id", text.alias("report"), good.alias("recommended"))


def _candidate_line() -> Column:
    return F.concat(F.lit("Кандидат: "), "doc_id", F.lit(" (файл: "), F.coalesce("filename", F.lit("—")), F.lit(")"))


def candidate_report(documents: DataFrame, evaluation: DataFrame) -> DataFrame:
    rows = _with_names(evaluation.filter("task_number <= 3"))
    plus = F.transform("passed_names", lambda n: F.concat(F.lit("+ "), n))
    minus = F.transform("failed_names", lambda n: F.concat(F.lit("- "), n))
    block = _lines(
        F.concat(F.lit("В "), "task_number", F.lit(" задании вы использовали:")),
        F.when(F.size("passed_names") > 0, F.array_join(plus, "\n")).otherwise("—"),
        F.when(F.size("failed_names") > 0, F.concat(F.lit("Еще было необходимо:\n"), F.array_join(minus, "\n"))),
        F.lit(""),
    )
    ready = documents.select("doc_id").join(_blocks(rows, block, F.lit(True)), "doc_id", "left")
    score = F.coalesce(fixed(F.col("overall"), 2), F.lit("—"))
    text = _lines(
        F.lit("Здравствуйте! По итогам вашей работы: "), F.col("body"),
        F.concat(F.lit("Итоговый балл: "), score, F.lit(". Спасибо за участие!")),
    )
    return ready.select("doc_id", text.alias("report"))


def _first_three(label: str, names: str) -> Column:
    more = F.when(F.size(names) > 3, F.concat(F.lit(" (+"), F.size(names) - 3, F.lit(" других)"))).otherwise("")
    return F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(F.slice(names, 1, 3), ", "), more))


def hr_report(documents: DataFrame, evaluation: DataFrame, report_time: Column) -> DataFrame:
    """The detailed report with warnings, chosen key, criteria and the score breakdown of every question."""
    rows = _with_names(evaluation)
    counted = F.col("task_number") <= 3
    kind = F.when(F.col("chosen") == "hr", "HR").otherwise("AI")
    delta = F.col("length_delta")

    def scored(label: str, missing: str, column: str, digits: int) -> Column:
        return F.coalesce(F.concat(F.lit(label), fixed(F.col(column), digits)), F.lit(missing))

    block = _lines(
        F.lit(RULE),
        F.concat(F.lit("Вопрос "), "task_number",
                 F.when(counted, "").otherwise(" (справочно, не учитывается в итоговой оценке)")),
        F.coalesce(
            F.concat(F.lit("Семантическое сходство: выбран "), kind, F.lit("-эталон ("), fixed(F.col("chosen_sim"), 4), F.lit(")")),
            F.lit("Семантическое сходство: не рассчитано (нет эталона)"),
        ),
        F.concat(F.lit("Критерии: выполнено "), F.size("passed_names"), F.lit(" из "),
                 F.size("passed_names") + F.size("failed_names")),
        _first_three("  - Выполненные: ", "passed_names"),
        _first_three("  - Не выполненные: ", "failed_names"),
        F.lit("Как рассчитана оценка:"),
        scored("  - Семантическое сходство с эталоном (1..10): ", "  - Семантическое сходство (1..10): не рассчитано", "cosine_score", 1),
        scored("  - Выполнение критериев (1..10): ", "  - Выполнение критериев (1..10): не применялось/нет данных", "criteria_score", 1),
        scored("  - Взвешенный балл до штрафов (70% cosine + 30% criteria): ", "  - Взвешенный балл до штрафов: нет данных", "blended_score", 2),
        F.when(delta < 0, F.concat(F.lit("  - Штраф за длину (короче AI-эталона): "), fixed(delta, 2)))
        .when(delta > 0, F.concat(F.lit("  - Бонус за длину (длиннее AI-эталона): +"), fixed(delta, 2)))
        .otherwise("  - Поправка за длину: 0.00"),
        scored("  - Итоговая оценка: ", "  - Итоговая оценка: нет данных", "final_score", 1),
        F.lit(""),
        F.lit("Результат системы:"),
        F.col("comment"),
        F.lit(""),
    )
    bodies = _blocks(rows, block, counted)
    warnings = evaluation.filter("warning IS NOT NULL").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("task_number", "warning"))).alias("w")
    ).select("doc_id", F.array_join(F.transform("w", lambda x: F.concat(F.lit("• "), x["warning"])), "\n").alias("warnings"))
    ready = documents.select("doc_id", "filename", "type").join(bodies, "doc_id", "left").join(warnings, "doc_id", "left")
    overall = F.coalesce(
        F.concat(F.lit("Итоговая оценка работы: "), fixed(F.col("overall"), 2), F.lit(" (среднее по вопросам 1–3)")),
        F.lit("Итоговая оценка работы: нет данных (не удалось посчитать среднее по вопросам 1–3)"),
    )
    text = _lines(
        F.lit("=== ОТЧЁТ ДЛЯ HR ==="),
        F.concat(F.lit("Дата анализа: "), report_time),
        _candidate_line(),
        F.concat(F.lit("Тип файла: "), F.coalesce("type", F.lit("—"))),
        F.lit(""),
        F.when(F.col("body").isNull(), NO_DATA).otherwise(
            _lines(
                F.when(F.col("warnings").isNotNull(), F.concat(F.lit("=== ПРЕДУПРЕЖДЕНИЯ ===\n"), F.col("warnings"), F.lit("\n"))),
                F.col("body"), F.lit(RULE), overall,
            )
        ),
    )
    return ready.select("doc_id", text.alias("report"))


def fallback_comment(similarity: Column, likelihood: Column) -> Column:
    band = F.when(similarity >= 0.8, K.COMMENT_HIGH).when(similarity >= 0.6, K.COMMENT_MEDIUM).otherwise(K.COMMENT_LOW)
    style = F.when(likelihood > 0.7, K.COMMENT_MACHINE).when(likelihood < 0.3, K.COMMENT_ORIGINAL)
    return F.concat_ws(" ", band, style, F.lit(K.COMMENT_CLOSING))


def fallback_impression(mean_score: Column, mean_similarity: Column, is_winner: Column) -> Column:
    good = F.concat_ws(
        " ",
        F.when(mean_score >= 7, K.IMPRESSION_GOOD_SCORE),
        F.when(mean_similarity >= 0.7, K.IMPRESSION_GOOD_MATCH),
    )
    middle = F.when(F.length(good) > 0, F.concat(good, F.lit("."))).otherwise(K.IMPRESSION_NEUTRAL)
    closing = F.when(is_winner, f"{K.IMPRESSION_CLOSING} {K.IMPRESSION_WINNER}").otherwise(K.IMPRESSION_CLOSING)
    return F.concat_ws("\n\n", F.lit(K.IMPRESSION_GREETING), middle, F.lit(K.IMPRESSION_WEAKNESS), closing)


def repair_impression(text: Column, is_winner: Column) -> Column:
    """Make sure a given text greets and closes properly."""
    t = T.strip(text)
    greeted = F.when(t.startswith(K.IMPRESSION_GREETING_START), t).otherwise(
        F.concat(F.lit(K.IMPRESSION_GREETING + " "), t)
    )
    closing = F.when(is_winner, K.IMPRESSION_WINNER).otherwise(K.IMPRESSION_CLOSING)
    present = F.when(is_winner, greeted.contains("Наш менеджер")).otherwise(greeted.contains("Желаем успехов"))
    return F.when(present, greeted).otherwise(F.concat(greeted, F.lit(" "), closing))


def fill(template: str, **values: Column) -> Column:
    """Concatenate a template with columns in place of the given names in braces."""
    pieces = re.split("(" + "|".join(rf"\{{{name}\}}" for name in values) + ")", template)
    return F.concat(*[values[p[1:-1]] if p[1:-1] in values and p[:1] == "{" else F.lit(p) for p in pieces if p])


def grading_prompt(task: Column, text: Column, similarity: Column, max_similarity: Column, likelihood: Column, readability: Column) -> Column:
    others = F.coalesce(fill(P.GRADING_OTHERS, max_similarity=percent(max_similarity)), F.lit(""))
    metrics = F.coalesce(
        fill(P.GRADING_METRICS, likelihood=percent(likelihood), readability=fixed(F.round(readability, 1), 1)), F.lit("")
    )
    return fill(
        P.GRADING, task_number=task.cast("string"), text=F.left(text, F.lit(500)), similarity_ref=percent(similarity),
        others=others, metrics=metrics,
    )


def logic_prompt(text: Column) -> Column:
    return fill(P.LOGIC, text=F.left(text, F.lit(500)))


def originality_prompt(text: Column, max_similarity: Column) -> Column:
    return fill(P.ORIGINALITY, text=F.left(text, F.lit(500)), max_similarity=percent(F.coalesce(max_similarity, F.lit(0.0))))


def tail_prompts(packed: DataFrame) -> DataFrame:
    """One prompt per answer of at least 20 characters with the beginnings of the other answers."""
    def one(k: int) -> Column:
        others = F.concat_ws(
            "\n",
            *[
                F.concat(F.lit(f"Задание {o}:\n"), F.left(F.coalesce(F.col(f"task_{o}"), F.lit("")), F.lit(200)), F.lit("..."))
                for o in K.TASKS
                if o != k
            ],
        )
        text = F.coalesce(F.col(f"task_{k}"), F.lit(""))
        prompt = fill(P.TAILS, task_number=F.lit(str(k)), text=F.left(text, F.lit(1000)), others=others)
        return F.struct(F.lit(k).alias("task_number"), F.when(F.length(T.strip(text)) >= K.TAIL_MIN_CHARS, prompt).alias("prompt"))

    rows = packed.select("doc_id", F.inline_outer(F.array(*[one(k) for k in K.TASKS])))
    return rows.filter("prompt IS NOT NULL")


def impression_prompts(answers: DataFrame, winners: Column, likelihood: Column) -> DataFrame:
    """``answers``: (doc_id, task_number, content, score, comment, similarity)."""
    block = F.concat(
        F.lit("Задание "), "task_number", F.lit(":\n"),
        F.when(F.length("content") > 0, F.concat(F.lit("Ответ: "), F.left("content", F.lit(300)), F.lit("\n"))).otherwise(""),
        F.coalesce(F.concat(F.lit("Оценка: "), F.col("score").cast("string"), F.lit("\n")), F.lit("")),
        F.when(F.length("comment") > 0, F.concat(F.lit("Комментарий: "), F.left("comment", F.lit(200)), F.lit("\n"))).otherwise(""),
        F.lit("\n"),
    )
    line = F.concat(F.lit("- task_"), "task_number", F.lit(": "), percent(F.col("similarity")), F.lit("\n"))
    grouped = answers.select("doc_id", "task_number", block.alias("block"), line.alias("line")).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("task_number", "block", "line"))).alias("b")
    )
    sims = F.array_join(F.transform("b", lambda x: F.coalesce(x["line"], F.lit(""))), "")
    text = F.concat(
        F.lit(P.IMPRESSION_HEAD), F.array_join(F.transform("b", lambda x: x["block"]), ""),
        F.when(F.length(sims) > 0, F.concat(F.lit("Схожесть с эталоном:\n"), sims)).otherwise(""),
        F.coalesce(F.concat(F.lit("Вероятность использования LLM: "), percent(likelihood), F.lit("\n")), F.lit("")),
        F.lit(P.IMPRESSION_TAIL), F.when(winners, P.IMPRESSION_WINNER).otherwise(""), F.lit(P.IMPRESSION_FORMAT),
    )
    return grouped.select("doc_id", text.alias("prompt"))


def summary_prompt(report: Column, audience: str) -> Column:
    template = {"hr": P.HR_SUMMARY, "candidate": P.CANDIDATE_SUMMARY}[audience]
    return fill(template, report=T.sanitize_for_prompt(report))


def metrics_summary(average: Column, content: Column, readability: Column, adjectives: Column, adverbs: Column, errors: Column) -> tuple[Column, Column]:
    """(likelihood percentage, list of metrics as text); numbers are rounded on their binary value."""
    share = F.coalesce(average, content)
    text = F.concat_ws(
        ", ",
        F.concat(F.lit("LLM вероятность: "), percent(average, round_half)),
        F.concat(F.lit("Читаемость: "), fixed(round_half(readability, 1), 1)),
        F.concat(F.lit("Прилагательных: "), adjectives.cast("string")),
        F.concat(F.lit("Наречий: "), adverbs.cast("string")),
        F.concat(F.lit("Ошибки пунктуации: "), errors.cast("string")),
    )
    return F.coalesce(percent(share, round_half), F.lit("-")), F.when(F.length(text) > 0, text).otherwise("-")


def submission_report(documents: DataFrame, packed: DataFrame, similarity: DataFrame, integrity: DataFrame, images: DataFrame) -> DataFrame:
    """One nested record per document; every side holds one row per document, so the joins keep its grain."""
    blank = F.greatest(*[T.is_blank(f"task_{k}").cast("int") for k in K.TASKS]) == 1
    counts = images.groupBy("doc_id").agg(F.count("*").alias("image_count"))
    joined = (
        documents.join(packed, "doc_id", "left").join(similarity, "doc_id", "left").join(integrity, "doc_id", "left")
        .join(counts, "doc_id", "left")
    )
    return joined.select(
        "doc_id", "filename", "processing_status",
        F.struct(*[F.col(f"task_{k}") for k in K.TASKS]).alias("tasks"),
        F.struct(*[c for c in similarity.columns if c != "doc_id"]).alias("similarity_with_existing"),
        F.struct(*[c for c in integrity.columns if c != "doc_id"]).alias("integrity"),
        blank.alias("has_parsing_problems"),
        (F.coalesce("image_count", F.lit(0)) > 0).alias("has_any_images"),
    )
