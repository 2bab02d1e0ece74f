"""Scoring arithmetic as Catalyst expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions.charcounts import char_counts
from markwell.functions.style import hits
from markwell.functions.text import Col, as_col, let, strip


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_half(value: Col, digits: int) -> Column:
    """Round the binary value half away from zero (``round`` would round its shortest decimal form); the sign stays, also that of zero."""
    scale = F.lit(float(10**digits))
    v = as_col(value)
    scaled = F.abs(v) * scale
    whole = F.floor(scaled)
    return F.signum(v) * (whole + (scaled - whole >= 0.5).cast("long")) / scale


def cosine_to_score(similarity: Col, lo: float = K.COSINE_LO, hi: float = K.COSINE_HI) -> Column:
    if hi <= lo:
        lo, hi = min(lo, hi), max(lo, hi) + 1e-6
    share = clip((as_col(similarity) - F.lit(lo)) / F.lit(hi - lo), 0.0, 1.0)
    return F.when(as_col(similarity).isNotNull(), round_half(clip(share * 10.0, 1.0, 10.0), 1))


def criteria_ratio(passed: Col, total: Col) -> Column:
    return clip(F.coalesce(F.try_divide(as_col(passed).cast("double"), as_col(total)), F.lit(0.0)), 0.0, 1.0)


def criteria_to_score(passed: Col, total: Col) -> Column:
    return 1.0 + 9.0 * criteria_ratio(passed, total)


def full_range_cosine_score(similarity: Col) -> Column:
    return 1.0 + 9.0 * ((clip(as_col(similarity), -1.0, 1.0) + 1.0) / 2.0)


def variant_b_score(similarity: Col, criteria_score: Col) -> Column:
    return 0.7 * full_range_cosine_score(similarity) + 0.3 * as_col(criteria_score)


def blend_score(cosine_score: Col, criteria_score: Col) -> Column:
    """Unrounded blend clipped to 1..10; the cosine score alone when there are no criteria."""
    both = K.WEIGHT_COSINE * as_col(cosine_score) + K.WEIGHT_CRITERIA * as_col(criteria_score)
    return F.when(
        as_col(cosine_score).isNotNull(), clip(F.coalesce(both, as_col(cosine_score)), 1.0, 10.0)
    )


def stripped_length(text: Col) -> Column:
    return F.length(strip(F.coalesce(as_col(text), F.lit(""))))


def length_ratio(answer_len: Col, key_len: Col) -> Column:
    ratio = (as_col(answer_len) + K.LENGTH_SMOOTHING) / (as_col(key_len) + K.LENGTH_SMOOTHING).cast("double")
    return F.when((as_col(answer_len) > 0) & (as_col(key_len) > 0), ratio)


def length_delta(ratio: Col) -> Column:
    r = as_col(ratio)
    shorter = -K.LENGTH_MAX_PENALTY * (1.0 - r)
    longer = K.LENGTH_MAX_BONUS * clip((r - 1.0) / 0.8, 0.0, 1.0)
    return F.when(r.isNull(), 0.0).otherwise(round_half(F.when(r < 1.0, shorter).otherwise(longer), 2))


def _portable(pattern: str) -> str:
    """Word edges and word characters that cover Cyrillic in any engine."""
    body = pattern
    if body.startswith(r"\b"):
        body = f"(?:^|[^{K.WORD_CLASS}])" + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + f"(?:$|[^{K.WORD_CLASS}])"
    return body.replace(r"\w", f"[{K.WORD_CLASS}]")


def _fixed_start(pattern: str) -> str:
    """Literal text every match starts with."""
    found = re.match(r"(?:\\b)?([\w ]*)(.?)", pattern)
    return found.group(1)[:-1] if found.group(2) in ("?", "*") else found.group(1)


def _occurs(normalized: Column, pattern: str) -> Column:
    """A match of the pattern in lower-case text; a substring test rejects most texts before the regex runs."""
    return normalized.contains(_fixed_start(pattern)) & normalized.rlike(_portable(pattern))


def uncertainty_hits(normalized: Col, patterns=K.UNCERTAINTY_PATTERNS) -> Column:
    """Number of patterns that occur in a text already passed through ``normalize_strip_punct``."""
    return sum((_occurs(as_col(normalized), p).cast("int") for p in patterns), F.lit(0))


def concreteness_coverage(normalized: Col, categories: dict = K.CONCRETENESS_PATTERNS) -> Column:
    """Number of categories with at least one pattern in the normalized text."""
    covered = [
        reduce(or_, (_occurs(as_col(normalized), p) for p in patterns)).cast("int") for patterns in categories.values()
    ]
    return sum(covered, F.lit(0))


def quality_penalties(base: Col, hits_count: Col, coverage: Col, normalized_length: Col) -> Column:
    vague = F.when((as_col(coverage) == 0) & (as_col(normalized_length) > 0), 1.0).otherwise(0.0)
    score = as_col(base) - 0.7 * F.least(as_col(hits_count), F.lit(3)) - vague
    return F.when(as_col(base).isNotNull(), round_half(clip(score, 1.0, 10.0), 1))


def grade_band(score: Col) -> Column:
    out = F.when(as_col(score).isNull(), K.GRADE_NONE)
    for minimum, text in K.GRADE_BANDS:
        out = out.when(as_col(score) >= minimum, text)
    return out.otherwise(K.GRADE_LOW)


def quality_score(text: Col, readability: Col) -> Column:
    """0..3 points for readability and words per sentence."""
    t, r = as_col(text), as_col(readability)
    ease = let(r, lambda v: F.when(v >= 50, F.least(F.lit(1.5), (v - 50) / 30 * 1.5)).otherwise(v / 50 * 1.5))
    n = char_counts(F.coalesce(t, F.lit("")))  # as analyze_text counts it, so both share one pass
    n_words = F.when(t.isNotNull(), n["tokens"])
    per_sentence = n_words / F.greatest(F.lit(1), n["marks"])
    shape = (
        F.when(n_words == 0, 0.0)
        .when(per_sentence.between(10, 20), 1.5)
        .when(((per_sentence >= 5) & (per_sentence < 10)) | ((per_sentence > 20) & (per_sentence <= 30)), 1.0)
        .otherwise(0.5)
    )
    total = F.least(F.lit(3.0), F.coalesce(ease, F.lit(0.0)) + shape)
    return F.when(F.coalesce(stripped_length(t), F.lit(0)) < 10, 0.0).otherwise(total)


def anti_cheating_score(likelihood: Col, total_errors: Col) -> Column:
    """0..2 points for a human style; 1 when the metrics are missing."""
    errors = as_col(total_errors)
    bonus = F.when(errors == 0, 0.2).when(errors <= 2, 0.1).otherwise(0.0)
    # the likelihood is named once: it may be a long expression over the text
    return clip(F.coalesce((1.0 - as_col(likelihood)) * 2.0 + bonus, F.lit(1.0)), 0.0, 2.0)


def auto_task_score(similarity: Col, quality: Col, anti_cheating: Col) -> Column:
    return clip(as_col(similarity) * 10 * 0.5 + as_col(quality) + as_col(anti_cheating), 0.0, 10.0)


def logic_score(text: Col, similarity: Col, likelihood: Col) -> Column:
    marks = hits(F.coalesce(as_col(text), F.lit("")), "[.!?]")
    shape = F.when(marks >= 3, 10.0).when(marks >= 1, 5.0).otherwise(0.0)
    near = F.when(as_col(similarity) > 0, as_col(similarity) * 30).otherwise(0.0)
    return clip(50.0 + near + shape - F.coalesce(as_col(likelihood) * 20, F.lit(0.0)), 0.0, 100.0)


def originality_score(max_similarity: Col, likelihood: Col) -> Column:
    base = (1.0 - F.coalesce(as_col(max_similarity), F.lit(0.0))) * 100
    return clip(base - F.coalesce(as_col(likelihood) * 20, F.lit(0.0)), 0.0, 100.0)
