"""Keyword criteria: a catalogue compiled into one expression per question, evaluated in place."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions.text import bind, normalize_ws_lower

MATCHED_KEYWORDS_KEPT = 20
DETAIL_TYPE = (
    "array<struct<criterion_no:int,name:string,matched:boolean,matched_keywords:array<string>,"
    "inverted:boolean,passed:boolean>>"
)


@dataclass(frozen=True)
class Criterion:
    name: str
    keywords: tuple[str, ...]
    inverted: bool = False

    @property
    def is_inverted(self) -> bool:
        return self.inverted or self.name.strip().lower() == K.INVERTED_CRITERION


Catalogue = dict[int, tuple[Criterion, ...]]


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyword_hit(normalized: str, keyword: str) -> str:
    """SQL text of the test: substring for phrases and special characters, whole word otherwise."""
    kw = re.sub(r"\s+", " ", keyword.lower()).strip()
    if not kw:
        return "false"
    found = f"contains({normalized}, {_literal(kw)})"
    if re.search(r"[^a-zа-я0-9_]", kw):
        return found
    # the cheap substring test rejects most texts before the regex runs
    return f"({found} AND rlike({normalized}, r'(?:^|[^{K.WORD_CLASS}]){kw}(?:$|[^{K.WORD_CLASS}])'))"


def _detail(number: int, criterion: Criterion, normalized: str) -> str:
    hits = ", ".join(f"if({keyword_hit(normalized, k)}, {_literal(k)}, NULL)" for k in criterion.keywords) or "NULL"
    found = f"array_compact(CAST(array({hits}) AS array<string>))"
    inverted = str(criterion.is_inverted).lower()
    return bind(
        found, "h",
        f"named_struct('criterion_no', {number}, 'name', {_literal(criterion.name)}, 'matched', size(h) > 0,"
        f" 'matched_keywords', slice(h, 1, {MATCHED_KEYWORDS_KEPT}), 'inverted', {inverted},"
        f" 'passed', (size(h) > 0) <> {inverted})",
    )


def criteria_details(question: str, normalized: str, catalogue: Catalogue) -> Column:
    """Array of criterion results for the question of the row; NULL where it has no criteria."""
    cases = [
        f"WHEN {question} = {number} THEN array({', '.join(_detail(i, c, normalized) for i, c in enumerate(criteria, 1))})"
        for number, criteria in sorted(catalogue.items())
        if criteria
    ]
    return F.expr(f"CASE {' '.join(cases)} END" if cases else "NULL").cast(DETAIL_TYPE)


def with_criteria(answers: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Add ``criteria_details``, ``criteria_passed`` and ``criteria_total`` to (…, task_number, content)."""
    prepared = answers.withColumn("_norm", normalize_ws_lower("content"))
    scored = prepared.withColumn(
        "criteria_details", criteria_details("task_number", "_norm", catalogue)
    ).drop("_norm")
    return scored.withColumns(
        {
            "criteria_passed": F.size(F.filter("criteria_details", lambda d: d["passed"])),
            "criteria_total": F.size("criteria_details"),
        }
    ).withColumns(
        {
            "criteria_passed": F.when(F.col("criteria_details").isNotNull(), F.col("criteria_passed")),
            "criteria_total": F.when(F.col("criteria_details").isNotNull(), F.col("criteria_total")),
        }
    )


def criteria_match(answers: DataFrame, catalogue: Catalogue) -> DataFrame:
    """One row per (answer, criterion)."""
    keys = [c for c in answers.columns if c != "content"]
    return with_criteria(answers, catalogue).select(*keys, F.inline_outer("criteria_details")).filter("name IS NOT NULL")


def apply_overrides(criteria: DataFrame, overrides: DataFrame, order: str | None = None) -> DataFrame:
    """Replace ``passed`` where (doc_id, task_number, name) has a manual override.

    Of repeated overrides the last by ``order`` counts; without an order, one that passes.
    """
    last = F.max_by("passed", order) if order else F.max("passed")
    manual = overrides.groupBy("doc_id", "task_number", "name").agg(last.alias("_manual"))
    return (
        criteria.join(manual, ["doc_id", "task_number", "name"], "left")
        .withColumn("passed", F.coalesce("_manual", "passed"))
        .drop("_manual")
    )
