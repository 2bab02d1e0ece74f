"""Catalogues and patterns that give varied results on the driver tables, with their oracle text."""

from __future__ import annotations

from markwell.operators.criteria import Criterion

CATALOGUE = {
    1: (
        Criterion("articles", ("the", "la", "der", "el")),
        Criterion("phrases", ("of the", "de la", "in der")),
        Criterion("no errors", ("worthless", "ion"), inverted=True),
    ),
    2: (Criterion("joins", ("and", "et", "und", "y")), Criterion("Отсутствие ошибок", ("that", "que"))),
    3: (
        Criterion("with", ("with", "avec", "mit", "con")),
        Criterion("to", ("to", "pour", "zu", "para")),
        Criterion("in", ("in", "dans", "im", "en")),
        Criterion("marks", ("is.", "le,")),
    ),
}
UNCERTAINTY = (r"\bthe\b", r"\bthat\b", r"\ble\b", r"\bque\b", r"\bund\b", r"\bnot\b")
CONCRETENESS = {
    "a": (r"\bwith\b", r"\bavec\b"),
    "b": (r"\bis\b", r"\best\b", r"\bist\b"),
    "c": (r"\bon\w*\b",),
    "d": (r"\bmit\b", r"\bcon\b"),
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def catalogue_values() -> str:
    rows = []
    for question, criteria in CATALOGUE.items():
        for number, c in enumerate(criteria, 1):
            for k, keyword in enumerate(c.keywords, 1):
                rows.append(f"({question}, {number}, {_q(c.name)}, {k}, {_q(keyword)}, {str(c.is_inverted).lower()})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(question, criterion_no, name, keyword_no, keyword, inverted)"


def any_pattern(column: str, patterns) -> str:
    edge = lambda p: p.replace(r"\w", "[<WD>]")
    parts = []
    for p in patterns:
        body = edge(p)
        body = "(^|[^<WD>])" + body[2:] if body.startswith(r"\b") else body
        body = body[:-2] + "($|[^<WD>])" if body.endswith(r"\b") else body
        parts.append(f"regexp_matches({column}, '(?i){body}')")
    return "(" + " OR ".join(parts) + ")"


def count_patterns(column: str, groups) -> str:
    return " + ".join(f"CAST({any_pattern(column, g)} AS INT)" for g in groups)
