"""Ranked lexical search of all documents for a set of query items, as blocked products of dense float64 matrices.

Documents shrink once to the item terms they hold. Weights need the whole corpus, so they are counted from that compact form;
then tiles of document impacts (terms x documents) meet the compact item vocabulary (items x terms) as BLAS products. A product
sums integers; tiles of the vocabulary are cut so that no sum reaches 2^53, where doubles stop being exact, and the tiles' sums
are added as 64-bit integers. Each task keeps the best documents of every item, ties included until they are ordered by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwell.llm.common import _TO_LOWER, stash, steps, text_buffer

TOP = 10

# What one pass over the documents compares them with, sent to every task: so many items, or so many different (item, term)
# pairs, whichever comes first; further items take a further pass. An item of more terms is a pass of its own.
GROUP_ITEMS = 512
GROUP_TERMS = 1 << 18

# Columns of a vocabulary tile and documents of a document tile.
TILE_TERMS = 4096
TILE_DOCS = 256

IMPACT = 1_000_000_000
LARGEST_IMPACT = IMPACT // 1000
EXACT = 1 << 53
# Repeats of one term in one item up to which a single product stays below 2^53 for any weight; others are added as integers.
MATRIX_REPEATS = 100_000

_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x30:0x3A] = _SOLID[0x41:0x5B] = _SOLID[0x61:0x7B] = _SOLID[0x80:] = True

BLOCK = "docs array<long>, lengths array<long>, sizes array<int>, terms array<int>, counts array<int>"


def column_terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a text column, lower-cased (A-Z), and for each row (plus one) the index of its first term."""
    data, offs = text_buffer(column)
    solid = _SOLID[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    starts_row = offs[:-1]
    before[starts_row[starts_row < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    kept = np.concatenate(([0], np.cumsum(solid)))  # where each byte lies once all others are gone
    bounds = np.append(kept[starts], kept[-1])
    body = _TO_LOWER[data[solid]]
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    return terms, np.searchsorted(starts, offs)


@dataclass
class Items:
    """A bounded group of items: their vocabulary, and term and number of each (item, term), items in order."""

    ids: list[int | None]
    vocabulary: pa.Array
    bounds: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, dict[bytes, int]]]) -> Items:
        vocabulary = sorted({t for _, counts in rows for t in counts})
        at = {t: i for i, t in enumerate(vocabulary)}
        bounds = np.concatenate(([0], np.cumsum([len(c) for _, c in rows]))).astype(np.int64)
        return cls(
            [i for i, _ in rows],
            pa.array(vocabulary, pa.large_binary()),
            bounds,
            np.array([at[t] for _, c in rows for t in c], dtype=np.int64),
            np.array([k for _, c in rows for k in c.values()], dtype=np.int64),
        )


def item_groups(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Items]:
    """Read the items group by group; items without a term are left out."""
    rows, pairs = [], 0
    source = items.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    for row in source.toLocalIterator():
        terms, _ = column_terms(pa.array([row["text"]], pa.string()))
        counted = terms.value_counts()
        counts = dict(zip(counted.field(0).to_pylist(), counted.field(1).to_pylist(), strict=True))
        if not counts:
            continue
        if rows and (len(rows) == GROUP_ITEMS or pairs + len(counts) > GROUP_TERMS):
            yield Items.of(rows)
            rows, pairs = [], 0
        rows.append((row["key"], counts))
        pairs += len(counts)
    if rows:
        yield Items.of(rows)


def shrink_documents(docs: DataFrame, items: Items, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents with at least one term: id, number of all terms, and the item terms each holds, with their numbers."""
    vocabulary = items.vocabulary
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                terms, first = column_terms(batch.column("text"))
                lengths = np.diff(first)
                some = np.flatnonzero(lengths)
                if not len(some):
                    continue
                found = pc.index_in(terms, value_set=vocabulary)
                hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                ids = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.searchsorted(first, hit, side="right") - 1
                pairs, counts = np.unique(owner * size + ids, return_counts=True)
                sizes = np.bincount(pairs // size, minlength=len(lengths))[some]

                def one(values, kind):
                    return pa.array([values], pa.list_(kind))

                yield pa.record_batch(
                    [
                        one(batch.column("key").take(pa.array(some)).to_pylist(), pa.int64()),
                        one(lengths[some], pa.int64()),
                        one(sizes.astype(np.int32), pa.int32()),
                        one((pairs % size).astype(np.int32), pa.int32()),
                        one(counts.astype(np.int32), pa.int32()),
                    ],
                    names=["docs", "lengths", "sizes", "terms", "counts"],
                )

    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, BLOCK)


def _block(batch: pa.RecordBatch, row: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    docs, *rest = (batch.column(c)[row].values for c in ("docs", "lengths", "sizes", "terms", "counts"))
    return docs, *(v.to_numpy(zero_copy_only=False) for v in rest)


@dataclass
class Corpus:
    """Number of documents with a term, number of all terms, and per item term the number of documents that hold it."""

    documents: int
    terms: int
    holders: np.ndarray

    def weights(self) -> np.ndarray:
        n = self.documents
        return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in self.holders], dtype=np.int64)

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        """The m of documents of these lengths."""
        if len(lengths) and 75 * int(lengths.max()) * self.documents >= 1 << 63:
            return np.array([25 + 75 * n * self.documents // self.terms for n in lengths.tolist()], dtype=np.int64)
        return 25 + 75 * lengths.astype(np.int64) * self.documents // self.terms


def count_corpus(blocks: DataFrame, items: Items) -> Corpus:
    """Counts over all documents: added up per task, then per term by a shuffle with at most one row per task and term."""
    size = len(items.vocabulary)

    def run(batches):
        documents = total = 0
        holders = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                docs, lengths, _, terms, _ = _block(batch, row)
                documents, total = documents + len(docs), total + int(lengths.sum())
                holders += np.bincount(terms, minlength=size)
        some = np.flatnonzero(holders)
        at = np.concatenate(([-2, -1], some))
        yield pa.record_batch([pa.array(at), pa.array(np.concatenate(([documents, total], holders[some])))], names=["at", "n"])

    counts = {r["at"]: r["n"] for r in blocks.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    return Corpus(counts.get(-2, 0), counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(size)], dtype=np.int64))


def vocabulary_tiles(items: Items, weights: np.ndarray) -> list[tuple[int, int]]:
    """Cut the vocabulary into column ranges over which no item's score can reach 2^53."""
    owner = np.repeat(np.arange(len(items.ids)), np.diff(items.bounds))
    order = np.argsort(items.terms, kind="stable")
    terms, owners = items.terms[order], owner[order]
    most = (np.minimum(items.repeats, MATRIX_REPEATS) * weights[items.terms] * LARGEST_IMPACT)[order]
    tiles, start, held = [], 0, np.zeros(len(items.ids), dtype=np.int64)
    firsts = np.searchsorted(terms, np.arange(len(weights) + 1))
    for column in range(len(weights)):
        rows = slice(firsts[column], firsts[column + 1])
        if (held[owners[rows]] + most[rows] >= EXACT).any() or column - start == TILE_TERMS:
            tiles.append((start, column))
            start, held = column, np.zeros(len(items.ids), dtype=np.int64)
        held[owners[rows]] += most[rows]
    return [*tiles, (start, len(weights))]


class Scorer:
    """The item side of the products, and the score of documents against all items of a group."""

    def __init__(self, items: Items, corpus: Corpus):
        self.corpus, self.items = corpus, items
        weights = corpus.weights()
        owner = np.repeat(np.arange(len(items.ids)), np.diff(items.bounds))
        values = items.repeats * weights[items.terms]
        large = items.repeats > MATRIX_REPEATS
        self.large = list(zip(owner[large], items.terms[large], values[large], strict=True))
        self.tiles = []
        for start, stop in vocabulary_tiles(items, weights):
            inside = (items.terms >= start) & (items.terms < stop) & ~large
            dense = np.zeros((len(items.ids), stop - start))
            dense[owner[inside], items.terms[inside] - start] = values[inside]
            self.tiles.append((start, stop, dense))

    def scores(self, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Items x documents, as 64-bit integers, of one document tile."""
        counts = counts.astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), sizes)
        impacts = IMPACT * counts // (1000 * counts + 8 * np.repeat(self.corpus.damping(lengths), sizes))
        total = np.zeros((len(self.items.ids), len(lengths)), dtype=np.int64)
        for start, stop, dense in self.tiles:
            inside = np.flatnonzero((terms >= start) & (terms < stop))
            if len(inside):
                # only columns that some document of the tile holds take part in the product
                used, at = np.unique(terms[inside] - start, return_inverse=True)
                tile = np.zeros((len(used), len(lengths)))
                tile[at, owner[inside]] = impacts[inside]
                total += (dense[:, used] @ tile).astype(np.int64)
        for item, term, value in self.large:
            total[item, owner[terms == term]] += value * impacts[terms == term]
        return total


@dataclass
class Best:
    """The best documents of each item so far, as flat columns."""

    top: int
    item: np.ndarray
    doc: np.ndarray
    named: np.ndarray
    score: np.ndarray

    @classmethod
    def none(cls, top: int) -> Best:
        return cls(top, *(np.zeros(0, dtype=k) for k in (np.int64, np.int64, bool, np.int64)))

    def add(self, scores: np.ndarray, docs: np.ndarray, named: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Take in a tile of scores (items x documents); the new least score of each item that could still enter.

        Whatever ties with the last place stays in until all of it is ordered by id, so no tie is cut at random.
        """
        k = min(self.top, scores.shape[1])
        last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        item, at = np.nonzero((scores >= np.maximum(last, floor)[:, None]) & (scores > 0))
        if not len(item):
            return floor
        item = np.concatenate((self.item, item))
        doc, named = np.concatenate((self.doc, docs[at])), np.concatenate((self.named, named[at]))
        score = np.concatenate((self.score, scores[item[len(self.item) :], at]))
        order = np.lexsort((doc, ~named, -score, item))
        item, doc, named, score = item[order], doc[order], named[order], score[order]
        first = np.searchsorted(item, np.arange(scores.shape[0] + 1))
        place = np.arange(len(item)) - first[item]
        keep = place < self.top
        floor = floor.copy()
        floor[item[place == self.top - 1]] = score[place == self.top - 1]
        self.item, self.doc, self.named, self.score = item[keep], doc[keep], named[keep], score[keep]
        return floor


def _best_per_task(blocks: DataFrame, items: Items, corpus: Corpus, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best = Scorer(items, corpus), Best.none(top)
        floor = np.zeros(len(items.ids), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                docs, lengths, sizes, terms, counts = _block(batch, row)
                named = docs.is_valid().to_numpy(zero_copy_only=False)
                docs = docs.fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
                for start in range(0, len(docs), TILE_DOCS):
                    stop = min(start + TILE_DOCS, len(docs))
                    inner = slice(ends[start], ends[stop])
                    tile = scorer.scores(lengths[start:stop], sizes[start:stop], terms[inner], counts[inner])
                    floor = best.add(tile, docs[start:stop], named[start:stop], floor)
        yield pa.record_batch(
            [
                pa.array(best.item),
                pa.array([items.ids[i] for i in best.item], pa.int64()),
                pa.array(best.doc, mask=~best.named),
                pa.array(best.score),
            ],
            names=["item", "item_id", "doc_id", "score"],
        )

    return blocks.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id"
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of highest score above 0 for each item, ties by ascending id.

    Items are read in groups of bounded size, each group against all documents. Null or empty texts have no terms: as documents
    they count nowhere, as items they find nothing. Repeated documents are documents of their own, as are items that share an
    id, each ranked for itself; null ids come last among ties. Other columns are not read, whatever their names; an empty
    table on either side gives no rows.
    """
    found = []
    for group in item_groups(items, item_key, text):
        blocks = stash(shrink_documents(docs, group, key, text))
        corpus = count_corpus(blocks, group)
        best = _best_per_task(blocks, group, corpus, top) if corpus.documents else None
        if best is not None:
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            found.append(ranked.select("item_id", "rank", "doc_id", "score"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = found[0]
    for more in found[1:]:
        result = result.unionAll(more)
    return result
