"""The corpus pipeline: each stage takes what its predecessor kept, written as Parquet and read again.

Toxic documents go; one document of each group of near copies stays; passages that also stand in an earlier document are cut
out; sources are mixed to their target weights, with repeats; the mix is tokenised and packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwell.llm.common import read_table, stash
from markwell.llm.minhash import keep_first
from markwell.llm.mixing import shuffled_mix
from markwell.llm.packing import pack
from markwell.llm.passages import cut_texts
from markwell.llm.toxicity import keep_clean

# Similarity from which documents are near copies, lower than in the query of op1.
NEAR_PERCENT = 80

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from the labelled rows among ``docs``."""
    return keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return keep_first(docs, percent=NEAR_PERCENT)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat a passage of a document with a smaller id; ``n_chars`` follows the text."""
    return cut_texts(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, dealt to shards and shuffled inside them: a document appears as often as it is taken."""
    return shuffled_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document's ids in a sequence."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_passages),
    ("mix_sources", mix),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage returns is written to the shared folder and read by the next one."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# Learned scores, hashes and tokens have no SQL twin; tests/llm compares the stages with brute-force versions.
ORACLE_SQL: str | None = None
