"""Writing-style metrics as Catalyst expressions."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from markwell import constants as K
from markwell.functions.charcounts import DOTTED, EXTRA_GROUP, char_counts
from markwell.functions.text import Col, as_col, let, normalize_strip_punct, strip

SP, WD = K.SPACE_CLASS, K.WORD_CLASS
# Marks of line starts follow the newline only, hence UNIX_LINES.
LINES = "(?md)"


def hits(text: Col, pattern: str) -> Column:
    return F.regexp_count(as_col(text), F.lit(pattern))


def readability(text: Col) -> Column:
    """Flesch reading ease with vowel groups as syllables; 0 below ten characters."""
    t = as_col(text)
    n = char_counts(t)
    n_words, n_sentences = F.greatest(n["words"], F.lit(1)), F.greatest(n["sentences"], F.lit(1))
    syllables = n["syllables"] - F.when(t.contains(DOTTED), hits(t, EXTRA_GROUP)).otherwise(0)
    score = 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (syllables / n_words)
    return F.when(F.coalesce(F.length(strip(t)), F.lit(0)) < 10, 0.0).otherwise(score)


def special_characters(text: Col) -> Column:
    t = as_col(text)
    n = char_counts(t)

    def known(value: Column) -> Column:
        return F.when(t.isNotNull(), value)

    return F.struct(
        known(n["emoji"] > 0).alias("has_emoji"),
        known(n["dashes"] > 0).alias("has_long_dash"),
        known(n["odd"] > 0).alias("has_special_unicode"),
        known(n["odd"]).alias("special_chars_count"),
    )


def punctuation_errors(text: Col) -> Column:
    t = as_col(text)
    n = char_counts(t)
    tight, double, lower_start = (F.when(t.isNotNull(), n[c]) for c in ("tight", "doubles", "lower_starts"))
    return F.struct(
        tight.alias("missing_spaces_after_punctuation"),
        double.alias("double_spaces"),
        lower_start.alias("missing_capitalization"),
        (tight + double + lower_start).alias("total_errors"),
    )


def _lookup(count: Column, *scores: float) -> Column:
    """Score by count, the last one for all greater counts; the count is evaluated once."""
    return F.get(F.array(*[F.lit(float(x)) for x in scores]), F.least(count, F.lit(len(scores) - 1)))


# Score by number of occurrences (0, 1, 2, ...), the last for any more.
NUMBERED_SCORES = (0.0, 0.05, 0.1, 0.15, 0.2)
BULLET_SCORES = (0.0, 0.05, 0.05, 0.05 + 0.05, 0.05 + 2 * 0.05, 0.2)
PHRASE_SCORES = (0.0, 0.1, 0.2, 0.3)
HEADER_SCORES = (0.0, 0.05, 0.05, 0.05 + 0.05, 0.2)
PATTERN_SCORES = (0.0, 0.05, 0.1)


# Characters that only matching without case takes for letters of the patterns, not lower case.
FOLDED = "[ıſİ\\x{1C80}-\\x{1C88}]"


def pattern_core(pattern: str) -> str:
    """The longest word that stands in every match of a formal pattern, or the pattern itself if it is plain text."""
    return max(pattern.split(r"\s+"), key=len)


def _formal(text: Column, low: Column, folded: Column, pattern: str) -> Column:
    """A match whatever the case; a search for its longest word in the lower-case text spares most texts the regex."""
    return (folded | low.contains(pattern_core(pattern))) & text.rlike("(?iu)" + pattern.replace(r"\s", f"[{SP}]"))


def llm_likelihood(text: Col) -> Column:
    """Share-like score of list, phrase and header habits of machine-written text."""
    t = as_col(text)
    numbered = hits(t, rf"\d+[.)][{SP}]+[А-Яа-яA-Z]")
    bullets = F.least(hits(t, "[•*]") + hits(t, rf"{LINES}^[{SP}]*[-–][{SP}]+"), F.lit(10))
    headers = hits(t, rf"{LINES}^[А-Яа-яA-Z][^.!?]{{0,50}}:")
    structured = t.contains(". ") | t.contains("\n")
    once = F.struct(F.lower(t).alias("low"), t.rlike(FOLDED).alias("folded"), F.length(strip(t)).alias("size"))

    def graded(o: Column) -> Column:
        phrases = sum((o["low"].contains(p).cast("int") for p in K.FORMAL_PHRASES), F.lit(0))
        patterns = sum((_formal(t, o["low"], o["folded"], p).cast("int") for p in K.FORMAL_PATTERNS), F.lit(0))
        score = (
            _lookup(numbered, *NUMBERED_SCORES)
            + _lookup(bullets, *BULLET_SCORES)
            + _lookup(phrases, *PHRASE_SCORES)
            + _lookup(headers, *HEADER_SCORES)
            + _lookup(patterns, *PATTERN_SCORES)
        )
        floor = F.greatest(score, F.when((o["size"] >= 100) & structured, 0.05).otherwise(0.0))
        return F.when(F.coalesce(o["size"], F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), floor))

    return let(once, graded)


def _match_f1(words: Column, ref: list[str]) -> Column:
    precision = F.size(F.filter(words, lambda w: w.isin(*sorted(set(ref))))) / F.size(words)
    recall = F.size(F.filter(F.array(*[F.lit(w) for w in ref]), lambda r: F.array_contains(words, r))) / len(ref)
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def reference_f1(text: Col, lines: list[str]) -> Column:
    """Greatest token-match F1 between the text and a configured list of style lines.

    The lines are configuration, compiled into the expression, so each text is scored in place.
    """
    tokens = F.filter(F.split(normalize_strip_punct(text), " "), lambda w: F.length(w) > 0)

    def best(words):
        scores = [F.lit(0.0)]
        for line in lines:
            ref = [w for w in re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", line.lower())).strip().split(" ") if w]
            if not ref:
                continue
            scores.append(_match_f1(words, ref))
        return F.greatest(*scores) if len(scores) > 1 else scores[0]

    score = F.get(F.transform(F.array(tokens), lambda ws: F.when(F.size(ws) > 0, best(ws)).otherwise(0.0)), F.lit(0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


# Stand between the words and the lines of references, and for a null word; no normalized text holds them.
WORD_END, LINE_END, NO_WORD = "\x1f", "\x1e", "\x1d"


def _best_f1(text: str, lines: list[tuple[list[str], set[str]]]) -> float:
    counts = Counter(text.split())
    total, best = sum(counts.values()), 0.0
    for line, distinct in lines if total else ():
        precision = sum(counts[w] for w in distinct if w in counts) / total
        recall = sum(w in counts for w in line) / len(line)
        if precision + recall > 0:
            best = max(best, 2 * precision * recall / (precision + recall))
    return best


@F.pandas_udf(DoubleType())
def _reference_scores(texts: pd.Series, references: pd.Series) -> pd.Series:
    lines = {}  # of each list of references in the batch, read once
    for joined in references.dropna().unique():
        words = [line.split(WORD_END) for line in joined.split(LINE_END) if line]
        lines[joined] = [(line, set(line)) for line in words]
    return pd.Series([_best_f1(t, lines.get(r, ())) for t, r in zip(texts, references)], dtype="float64")


def reference_f1_of(text: Col, references: Col) -> Column:
    """Greatest token-match F1 between the text and any of the row's ``references`` (lists of words).

    The words of a text are counted once, so its cost is its length plus the words of its references, not their product.
    """
    lines = F.transform(as_col(references), lambda r: F.array_join(r, WORD_END, NO_WORD))
    return _reference_scores(normalize_strip_punct(text), F.array_join(lines, LINE_END))


def analyze_text(text: Col, likelihood: Column | None = None) -> Column:
    """All metrics of one text; NULL counts as the empty text."""
    t = F.coalesce(as_col(text), F.lit(""))
    return F.struct(
        readability(t).alias("readability"),
        F.lit(0).alias("adjectives_count"),
        F.lit(0).alias("adverbs_count"),
        char_counts(t)["tokens"].alias("total_words"),
        special_characters(t).alias("special_chars"),
        punctuation_errors(t).alias("punctuation_errors"),
        (llm_likelihood(t) if likelihood is None else likelihood).alias("llm_likelihood"),
    )
