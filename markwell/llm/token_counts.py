"""Token counts from flat token streams without an index: vectorised separator scan, stitched across blocks by a prefix scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwell.llm.common import stash, steps
from markwell.llm.tokens import default_vocabulary, encode_column

SEPARATOR = 50256
BLOCK_TOKENS = 1 << 17
ITEM = "<u2"


def token_stream(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    separator: int = SEPARATOR,
    block_tokens: int = BLOCK_TOKENS,
    item: str = ITEM,
) -> DataFrame:
    """Write the ids of all documents into flat streams, the separator behind each document, and cut them blindly into blocks.

    One stream (``file``) per task. Rows are blocks ``(file, block, data)`` or parts of the list of written documents
    ``(file, first, keys)``, where ``first`` is the ordinal of the first key in its stream. Special strings inside a text are
    ordinary text, so the separator's id marks ends of documents only. Null text is empty.
    """
    path = vocabulary or default_vocabulary()
    kind = np.dtype(item)

    def rows(file: int, blocks: list, lists: list) -> pa.RecordBatch:
        n, m = len(blocks), len(lists)
        return pa.record_batch(
            [
                pa.array([file] * (n + m), pa.int64()),
                pa.array([b for b, _ in blocks] + [None] * m, pa.int64()),
                pa.array([d for _, d in blocks] + [None] * m, pa.binary()),
                pa.array([None] * n + [f for f, _ in lists], pa.int64()),
                pa.array([None] * n + [k for _, k in lists], pa.list_(pa.int64())),
            ],
            names=["file", "block", "data", "first", "keys"],
        )

    def run(batches: Iterator[pa.RecordBatch]):
        file, block, written = TaskContext.get().partitionId(), 0, 0
        tail = np.zeros(0, dtype=kind)
        for whole in batches:
            for batch in steps(whole, "text"):
                ids, bounds = encode_column(batch.column("text"), path, specials=False)
                stream = np.insert(ids.astype(kind), bounds[1:], kind.type(separator))
                stream = np.concatenate((tail, stream))
                full = len(stream) // block_tokens
                blocks = [(block + i, stream[i * block_tokens : (i + 1) * block_tokens].tobytes()) for i in range(full)]
                tail = stream[full * block_tokens :]
                yield rows(file, blocks, [(written, batch.column("key").to_pylist())])
                block += full
                written += batch.num_rows
        if len(tail):
            yield rows(file, [(block, tail.tobytes())], [])

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "file long, block long, data binary, first long, keys array<long>")


def scan_separators(blocks: DataFrame, separator: int = SEPARATOR, item: str = ITEM) -> DataFrame:
    """``(file, ordinal, n_tokens, terminated)`` for every document of the streams ``(file, block, data)``.

    Each block is searched alone: ids before its first separator, between separators, and behind the last. A prefix scan over
    these summaries in block order numbers the documents and adds what earlier blocks hold of a document that goes on. Ids
    behind the last separator of a file are a last document that is not terminated. The separator is never counted. Empty or
    null blocks count nothing; a block that cuts an id in two raises an error.
    """
    kind = np.dtype(item)

    def summarise(batches):
        for batch in batches:
            out = []
            for file, block, data in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "data")), strict=True):
                ids = np.frombuffer(data or b"", dtype=kind)
                at = np.flatnonzero(ids == separator)
                head, last = (int(at[0]), int(at[-1])) if len(at) else (None, None)
                out.append((file, block, len(ids), len(at), head, last, np.diff(at) - 1))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64()] * 6 + [pa.list_(pa.int64())]
            names = ["file", "block", "n", "ends", "head", "last", "inner"]
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    parts = blocks.select(F.col("file").cast("long").alias("file"), F.col("block").cast("long").alias("block"), "data").mapInArrow(
        summarise, "file long, block long, n long, ends long, head long, last long, inner array<long>"
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("open_from", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)))
        .withColumn("is_last", F.lead("block").over(order).isNull())
    )
    ended = F.when(
        F.col("ends") > 0, F.concat(F.array(F.col("base") + F.col("head") - F.col("open_from")), F.col("inner"))
    ).otherwise(F.array().cast("array<long>"))
    end = F.col("base") + F.col("n")
    rest = end - F.when(F.col("ends") > 0, F.col("base") + F.col("last") + 1).otherwise(F.col("open_from"))
    counts = placed.select(
        "file",
        "first",
        F.when(F.col("is_last") & (rest > 0), F.concat(ended, F.array(rest))).otherwise(ended).alias("counts"),
        F.col("ends"),
    )
    return counts.select("file", "first", "ends", F.posexplode("counts").alias("at", "n_tokens")).select(
        "file", (F.col("first") + F.col("at")).alias("ordinal"), "n_tokens", (F.col("at") < F.col("ends")).alias("terminated")
    )


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, **options) -> DataFrame:
    """``(doc_id, n_tokens)`` per row of ``docs``, counted in the written token streams. Null or empty text: 0; repeated rows and
    null keys are counted once each; other columns are not read; an empty table gives no rows."""
    stream = stash(token_stream(docs, key, text, vocabulary, **options))
    counts = scan_separators(stream.filter(F.col("data").isNotNull()), options.get("separator", SEPARATOR), options.get("item", ITEM))
    written = stream.filter(F.col("keys").isNotNull()).select("file", "first", F.posexplode("keys").alias("at", "doc_id"))
    written = written.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")
    return written.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
