"""Named extension points: embedders, decoders and likelihood scorers, each a column builder."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions import style, vectors
from markwell.functions.text import strip

Builder = Callable[[Column], Column]


class Registry:
    """Name to column builder; a builder may wrap a user's ``pandas_udf``."""

    def __init__(self, kind: str, builders: dict[str, Builder]):
        self.kind = kind
        self._builders = dict(builders)

    def register(self, name: str, builder: Builder) -> None:
        self._builders[name.strip().lower()] = builder

    def get(self, name: str) -> Builder:
        try:
            return self._builders[name.strip().lower()]
        except KeyError:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {sorted(self._builders)}") from None

    def names(self) -> list[str]:
        return sorted(self._builders)


# Bytes 128..255 of code page 1251, in order; undefined bytes become the replacement character.
_CP1251_HIGH = bytes(range(128, 256)).decode("cp1251", errors="replace")
_LATIN1_HIGH = bytes(range(128, 256)).decode("latin-1")


def decode_text(data: Column) -> Column:
    """UTF-8 where the bytes are valid, code page 1251 otherwise; no session option needed."""
    single_byte = F.translate(F.decode(data, "ISO-8859-1"), _LATIN1_HIGH, _CP1251_HIGH)
    return F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(single_byte)


EMBEDDERS = Registry("embedder", {"hashed_words": vectors.hashed_words, "hashed_bigrams": vectors.hashed_bigrams})
DECODERS = Registry("decoder", {name: decode_text for name in K.TEXT_TYPES})
LIKELIHOOD = Registry("likelihood scorer", {"heuristic": style.llm_likelihood})


def embedder(name: str) -> Builder:
    return EMBEDDERS.get(name)


def likelihood_scorer(name: str | None = None, lines: list[str] | None = None) -> Builder:
    """'heuristic' (default), 'reference' (token F1 against style lines) or a registered one."""
    if (name or "heuristic").strip().lower() == "reference":
        return partial(_reference, lines=lines or [K.DEFAULT_STYLE_REFERENCE])
    return LIKELIHOOD.get(name or "heuristic")


def _reference(text: Column, lines: list[str]) -> Column:
    return style.reference_f1(strip(text), lines)
