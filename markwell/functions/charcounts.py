"""Counts over the characters of texts, vectorised inside tasks: each character is classified once, and all counts read its class."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from markwell import constants as K

VOWELS = "aeiouyàâäáéèêëíîïóôöúùûüœæаеёиоуыэюя"
# A capital whose lower case is two characters, so that the next vowel begins a new group; readability takes it as one vowel.
DOTTED = "İ"
EXTRA_GROUP = f"{DOTTED}(?=[{VOWELS}{VOWELS.upper()}{DOTTED}])"
EMOJI = ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x2702, 0x27B0), (0x24C2, 0x1F251))
# Stands between texts; a surrogate, so no text holds it.
BORDER = "\ud800"
# Characters that one vectorised step holds at once; a longer single text is still taken whole.
STEP_CHARS = 1 << 20

SPACE, WORD, VOWEL, JOINS, END, CLAUSE, ODD, SYMBOL, DASH, BLANK, LETTER, UPPER, LIMIT = (1 << k for k in range(13))
FIELDS = ("words", "sentences", "marks", "syllables", "tokens", "odd", "emoji", "dashes", "tight", "doubles", "lower_starts")


def _class_of(code: int) -> int:
    c = chr(code)
    if c == BORDER:
        return LIMIT
    kind = unicodedata.category(c)
    space = kind[0] == "Z" or c in K.SPACE_CHARS
    word = kind[0] in "LN" or c == "_"
    vowel = c.lower()[0] in VOWELS
    return (
        SPACE * space + WORD * word + VOWEL * vowel
        + JOINS * (vowel and c != DOTTED)
        + END * (c in ".!?") + CLAUSE * (c in ".,;:!?") + ODD * (not word and not space and c not in ".,;:!?-()[]{}\"'")
        + SYMBOL * any(a <= code <= b for a, b in EMOJI) + DASH * (c in "—–") + BLANK * (c == " ")
        + LETTER * ("А" <= c <= "Я" or "а" <= c <= "я" or "A" <= c <= "Z" or "a" <= c <= "z") + UPPER * (kind == "Lu")
    )


@lru_cache(maxsize=1)
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """The classes of all code points as (class, length) runs, small enough to travel with the function."""
    classes = np.fromiter((_class_of(code) for code in range(0x110000)), dtype=np.uint16, count=0x110000)
    starts = np.flatnonzero(np.diff(classes, prepend=classes[0] ^ 1))
    return classes[starts], np.diff(starts, append=len(classes))


def count_classes(texts: list[str], classes: np.ndarray) -> np.ndarray:
    """One row of ``FIELDS`` per text."""
    joined = BORDER + BORDER.join(texts) + BORDER
    mark = classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    borders = np.flatnonzero(mark == LIMIT)
    before, here = mark[:-1], mark[1:]

    def per_text(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, borders))

    def at(found: np.ndarray) -> np.ndarray:
        return per_text(np.flatnonzero(found) + 1)

    def starts(kind: int, stop: int | None = None) -> np.ndarray:
        return ((here & kind) != 0) & ((before & (stop or kind)) == 0)

    blanks = starts(BLANK)
    blanks[:-1] &= (here[1:] & BLANK) != 0
    # runs of white space: those behind the end of a sentence, and what comes after them
    first = np.flatnonzero(starts(SPACE)) + 1
    after = np.flatnonzero(((here & SPACE) == 0) & ((before & SPACE) != 0)) + 1
    after = after[(mark[first - 1] & END) != 0]
    after = after[(mark[after] & (UPPER | LIMIT)) == 0]
    empty = ((mark[after] & END) != 0) & ((mark[after + 1] & SPACE) != 0)
    return np.column_stack([
        at(starts(WORD)), at(starts(END)), at((here & END) != 0), at(starts(VOWEL, JOINS)),
        at(((here & (SPACE | LIMIT)) == 0) & ((before & (SPACE | LIMIT)) != 0)), at((here & ODD) != 0), at((here & SYMBOL) != 0),
        at((here & DASH) != 0), at(((before & CLAUSE) != 0) & ((here & LETTER) != 0)), at(blanks), per_text(after[~empty]),
    ]).astype(np.int32)


def steps(texts: list[str]) -> Iterator[list[str]]:
    step, size = [], 0
    for text in texts:
        step.append(text)
        size += len(text)
        if size >= STEP_CHARS:
            yield step
            step, size = [], 0
    if step:
        yield step


def counted(texts: pd.Series, classes: np.ndarray) -> pd.DataFrame:
    parts = [count_classes(step, classes) for step in steps(texts.fillna("").tolist())]
    return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(FIELDS)), np.int32), columns=list(FIELDS))


@lru_cache(maxsize=1)
def _counter():
    runs = class_runs()

    @F.pandas_udf(", ".join(f"{name} int" for name in FIELDS))
    def char_counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classes = np.repeat(*runs)
        for texts in batches:
            yield counted(texts, classes)

    return char_counts


def char_counts(text: Column) -> Column:
    """Struct of ``FIELDS``; all 0 for NULL. Several calls on one text are evaluated once per plan node."""
    return _counter()(text)


@lru_cache(maxsize=1)
def readability_function():
    """Flesch reading ease as a function for SQL; see ``style.readability``."""
    runs = class_runs()

    @F.pandas_udf("double")
    def readability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classes = np.repeat(*runs)
        for texts in batches:
            n = counted(texts, classes)
            words = n["words"].clip(lower=1)
            extra = texts.fillna("").map(lambda t: len(re.findall(EXTRA_GROUP, t)) if DOTTED in t else 0).astype("int64")
            syllables = n["syllables"] - extra.to_numpy()
            score = 206.835 - 1.015 * (words / n["sentences"].clip(lower=1)) - 84.6 * (syllables / words)
            short = texts.fillna("").map(lambda t: len(t.strip(K.SPACE_CHARS)) < 10).astype(bool)
            yield score.mask(short.to_numpy(), 0.0)

    return readability
