"""Exact copies by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwell.operators.skew import skew_join
from markwell.session import cut_lineage


def exact_duplicates(hashed: DataFrame) -> DataFrame:
    """(doc_id, file_hash, first_id, copies) for every document with a copy.

    Group facts come from a map-side combined aggregate and are joined back with ``skew_join``, so a hash shared
    by a large part of the corpus neither gathers in one task nor becomes one collected group.
    """
    hashed = cut_lineage(hashed)  # the hash is computed from the texts once
    groups = hashed.groupBy("file_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return skew_join(hashed, groups.filter("copies > 1"), "file_hash").select("doc_id", "file_hash", "first_id", "copies")
