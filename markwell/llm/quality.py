"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwell.llm.common import mix, ngram_hashes, span_hashes, stash, steps, text_buffer, word_spans

BUCKET_BITS = 16
GRAM = 4
# Bits that say which rows may be trusted, and decimals to which scores are counted to set the threshold: both bound what the
# driver gets; every labelled row counts.
MARK_BITS = 1 << 23
SCORE_DIGITS = 4
# Rows in which a task sends its counts.
COUNT_PARTS = 16
# Share of good labelled texts that the threshold must keep, and the threshold without labels of both kinds.
KEEP_GOOD = 0.995
DEFAULT_THRESHOLD = -0.25
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between bounds."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Names that differ between rows of a batch."""
    return mix(hashes + mix(rows.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)))


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text."""
    data, offs = text_buffer(column)
    n = len(offs) - 1
    starts, ends, first = word_spans(data, offs)
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = letters[ends] - letters[starts]
    words = span_hashes(data, starts, ends)
    grams, bounds = ngram_hashes(words, first, 3)
    rows = np.repeat(np.arange(n), np.diff(bounds))
    _, which, often = np.unique(_in_row(grams, rows), return_inverse=True, return_counts=True)
    at = (first[:-1][rows] + np.arange(len(grams)) - bounds[:-1][rows])[often[which] > 1]
    covered = np.zeros(len(words) + 2, dtype=bool)
    for k in range(3):
        covered[at + k] = True
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offs] = True
    cut[1:][data == 0x0A] = True
    line_ends = np.flatnonzero(cut[1:]) + 1
    line_starts = np.concatenate(([0], line_ends[:-1])) if len(line_ends) else line_ends
    # the break itself is not part of a line
    stops = line_ends - (data[line_ends - 1] == 0x0A) if len(line_ends) else line_ends
    has_word = np.searchsorted(starts, stops) > np.searchsorted(starts, line_starts)
    line_starts, stops = line_starts[has_word], stops[has_word]
    line_rows = np.searchsorted(offs, line_starts, side="right") - 1
    _, sample = np.unique(_in_row(span_hashes(data, line_starts, stops), line_rows), return_index=True)
    lines = np.bincount(line_rows, minlength=n) - np.bincount(line_rows[sample], minlength=n)
    return {
        "n_words": np.diff(first),
        "word_chars": _per_row(chars, first),
        "n_symbols": _per_row(_IS_SYMBOL[data], offs),
        "n_dup_lines": lines,
        "n_repeat_words": _per_row(covered[: len(words)], first),
    }


def gram_buckets(column: pa.Array, bits: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram of each text, and each row's bounds among them."""
    data, offs = text_buffer(column)
    n = max(len(data) - gram + 1, 0)
    total = np.zeros(n, dtype=np.uint32)
    for k in range(gram):
        total = total * np.uint32(0x01000193) + data[k : k + n].astype(np.uint32)
    buckets = (total * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    counts = np.maximum(np.diff(offs) - gram + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if len(buckets):
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        np.add.at(inside, offs[:-1], 1)
        np.add.at(inside, offs[:-1] + counts, -1)
        buckets = buckets[np.cumsum(inside[:n], dtype=np.int32) > 0]
    return buckets, bounds


def _counts(texts: DataFrame, bits: int, gram: int) -> np.ndarray:
    """N-gram counts of all texts; ``2^bits`` numbers, whatever the input."""
    size = 1 << bits

    def run(batches):
        counts = np.zeros(size, dtype=np.int64)
        for whole in batches:
            for batch in steps(whole, "text"):
                counts += np.bincount(gram_buckets(batch.column("text"), bits, gram)[0], minlength=size)
        parts = [part.tobytes() for part in counts.reshape(COUNT_PARTS, -1)]
        yield pa.record_batch([pa.array(range(COUNT_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = np.zeros(size // COUNT_PARTS, dtype=np.int64), None
        for batch in batches:
            part = batch.column("part")[0].as_py()
            for one in batch.column("counts"):
                counts += np.frombuffer(one.as_buffer(), dtype=np.int64)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["part", "counts"])

    kinds = "part int, counts binary"
    counts = np.zeros((COUNT_PARTS, size // COUNT_PARTS))
    for row in texts.select("text").mapInArrow(run, kinds).groupBy("part").applyInArrow(total, kinds).collect():
        counts[row["part"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return counts.reshape(-1)


def _trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is trusted. A fixed bit array keeps most others out of the shuffle; the join decides."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))
    marks = np.zeros(MARK_BITS // 8, dtype=np.uint8)
    at = trusted.select(F.shiftright(slot, 3).alias("at"), F.expr(f"shiftleft(1, int(pmod(xxhash64(doc_id), {MARK_BITS}) % 8))").alias("bit"))
    for row in at.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        marks[row["at"]] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf("boolean")
    def marked(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7)) & 1 == 1)

    return docs.filter(marked(slot)).join(trusted.select("doc_id").hint("shuffle_merge"), "doc_id", "left_semi")


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log of the target's probability over the raw corpus's, per bucket; the target is smoothed towards the corpus."""
    raw_share = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    pull = max(good.sum() / len(good), 1.0)
    good_share = (good + pull * raw_share) / (good.sum() + pull)
    return np.log(good_share) - np.log(raw_share)


def threshold_of(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The cut between two neighbouring ``scores`` that best separates their ``good`` and ``bad`` texts, but keeps ``keep_good`` of the good ones."""
    if not good.any() or not bad.any():
        return DEFAULT_THRESHOLD
    order = np.argsort(scores, kind="stable")
    s, g, b = scores[order], good[order], bad[order]
    lost = np.cumsum(g) / g.sum()
    value = np.cumsum(b) / b.sum() - lost
    usable = (s[1:] > s[:-1]) & (lost[:-1] <= 1 - keep_good)
    if not usable.any() or value[:-1][usable].max() <= 0:
        return float(s[0] - 10.0**-SCORE_DIGITS)
    k = int(np.argmax(np.where(usable, value[:-1], -1.0)))
    return float((s[k] + s[k + 1]) / 2)


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    bits: int = BUCKET_BITS,
    gram: int = GRAM,
) -> DataFrame:
    """One row per row of ``docs``: base counts, ``base_failed``, the length-normalised ``score`` and ``kept``.

    The target model counts hashed byte n-grams of all trusted texts (label 1), the raw model those of all texts; both are summed
    over the tasks and have ``2^bits`` entries. A text's score is the mean log ratio of its n-grams, 0 if it has none. One
    threshold, set by all labelled texts, decides every text. Null or empty texts have no words and fail the base rule. Null keys
    have no label but are judged; a key labelled twice counts by its best label; an empty table gives no rows; without labels
    of both kinds a fixed threshold holds. Only the named columns are read.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    trusted = known.filter("label = 1")
    ratios = log_ratios(_counts(plain, bits, gram), _counts(_trusted_texts(plain, trusted), bits, gram))

    def run(batches):
        for whole in batches:
            for batch in steps(whole, "text"):
                counts = base_counts(batch.column("text"))
                buckets, bounds = gram_buckets(batch.column("text"), bits, gram)
                total = np.concatenate(([0.0], np.cumsum(ratios[buckets])))
                score = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
                columns = [batch.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in counts.values()), pa.array(np.round(score, 9))]
                yield pa.record_batch(columns, names=["doc_id", *counts, "score"])

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    scored = stash(plain.mapInArrow(run, kinds).withColumn("base_failed", failed))
    seen = scored.filter("not base_failed").select("doc_id", F.round("score", SCORE_DIGITS).alias("score")).join(known, "doc_id")
    is_good = F.col("label") == 1
    seen = seen.groupBy("score").agg(F.count_if(is_good).alias("good"), F.count_if(~is_good).alias("bad")).toPandas()
    cut = threshold_of(*(seen[c].to_numpy(dtype=float) for c in ("score", "good", "bad")))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= cut))
