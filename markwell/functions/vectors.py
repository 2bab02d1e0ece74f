"""Dense vectors as array<double> columns: hashing, norms, dot products, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markwell.functions.text import Col, as_col, let, normalize_strip_punct, run_lengths

DIMENSIONS = 64


def token_bucket(token: Col, dimensions: int = DIMENSIONS) -> Column:
    digest = F.substring(F.md5(as_col(token)), 1, 8)
    if 256 % dimensions == 0:  # the last two digits decide
        digest = F.substring(F.md5(as_col(token)), 7, 2)
    return (F.conv(digest, 16, 10).cast("bigint") % dimensions).cast("int")


def _histogram(buckets: Column, dimensions: int) -> Column:
    """Dense counts: run lengths of the sorted buckets, spread over the dimensions."""
    counts = F.map_from_entries(F.coalesce(run_lengths(F.sort_array(buckets)), F.array().cast("array<struct<value:int,n:int>>")))
    return let(
        counts,
        lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("double")
        ),
    )


def hashed_words(text: Col, dimensions: int = DIMENSIONS) -> Column:
    """Bag of words hashed into ``dimensions`` counts; a blank text gives the zero vector."""
    tokens = F.filter(F.split(normalize_strip_punct(text), " "), lambda t: F.length(t) > 0)
    return _histogram(F.transform(tokens, lambda t: token_bucket(t, dimensions)), dimensions)


def hashed_bigrams(text: Col, dimensions: int = DIMENSIONS) -> Column:
    """Words and neighbouring word pairs hashed into one count vector."""
    tokens = F.filter(F.split(normalize_strip_punct(text), " "), lambda t: F.length(t) > 0)

    def grams(words):
        pairs = F.zip_with(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
            F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return F.transform(F.concat(words, pairs), lambda t: token_bucket(t, dimensions))

    return _histogram(let(tokens, grams), dimensions)


def dot(a: Col, b: Col) -> Column:
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Col) -> Column:
    return F.aggregate(as_col(a), F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Col, b: Col) -> Column:
    """Cosine similarity; 0.0 when a vector is missing or zero."""
    return cosine_of(a, b, squared_norm(a), squared_norm(b))


def cosine_of(a: Col, b: Col, a_square: Column, b_square: Column) -> Column:
    """Cosine similarity of vectors whose squared norms are known."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(a_square * b_square)), F.lit(0.0))


def l2_normalize(a: Col) -> Column:
    v = as_col(a)
    unit = let(F.sqrt(squared_norm(v)), lambda n: F.transform(v, lambda x: x / n))
    return F.when(squared_norm(v) > 0, unit).otherwise(v)
