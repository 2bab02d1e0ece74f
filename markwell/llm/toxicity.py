"""Toxicity of whole texts: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwell.llm.common import mix, span_hashes, stash, steps, text_buffer

# Labelled rows of each class that the lexicon and the model are fitted on: the first by hash of their id.
ROWS_PER_CLASS = 6_000
# Learned stems that are kept, and the bar that each must pass: chance of its counts without any tie to the label.
LEXICON_SIZE = 4_096
LEAST_EVIDENCE = 12.0
STEM_BYTES = (4, 5, 6)
NEAR = 5
HELD_OUT_OF = 5

# Insults, and pronouns of the second person.
INSULTS = (
    "idiot", "moron", "loser", "scum", "trash", "stupid", "pathetic", "worthless", "disgusting", "clown", "fool", "dumb",
    "imbecile", "vermin", "filth", "garbage", "freak", "creep", "pig", "rat", "liar", "coward", "ugly", "hate", "shut", "kill",
    "die", "crap", "damn", "bastard", "bitch", "shit", "fuck", "asshole", "jerk", "retard", "dummkopf", "arschloch", "abschaum",
    "connard", "salope", "merde", "imbécile", "idiota", "estúpido", "imbécil", "basura", "mierda", "cabrón", "ordure",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich",
    "dir", "dein", "deine", "ihr", "euch", "usted", "ustedes", "tú", "ti", "tus", "vosotros",
)

FEATURES = (
    "insult_density", "insult_words", "stem_density", "stem_words", "stem_weight", "near_second_person", "second_person",
    "capital_share", "shouted_words", "exclamations", "questions", "punctuation", "obfuscated_words", "log_words",
)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_MASK = np.zeros(256, dtype=bool)
_MASK[list(b"0123456789@$!*.-_+")] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of letters, and for each row (plus one) the index of its first run."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = _LETTER[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offs] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _names(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per run of letters the names of the whole word and of its stems; a word too short for a stem has none (0)."""
    found = [span_hashes(low, starts, ends)]
    for k in STEM_BYTES:
        stem = mix(span_hashes(low, starts, np.minimum(starts + k, ends)) + np.uint64(k))
        found.append(np.where(ends - starts > k, stem, np.uint64(0)))
    return found


def _word_names(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(
        np.concatenate([span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)])) for b in (w.encode() for w in words)])
    )


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def dense_features(column: pa.Array, stems: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; all zero for a text without letters."""
    data, offs = text_buffer(column)
    low = _TO_LOWER[data]
    starts, ends, first = _runs(data, offs)

    def per_row(values: np.ndarray, bounds: np.ndarray = first) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
        return total[bounds[1:]] - total[bounds[:-1]]

    names = _names(low, starts, ends)
    insult = _among(names[0], _word_names(INSULTS)) >= 0
    you = _among(names[0], _word_names(SECOND_PERSON)) >= 0
    weight = np.zeros(len(starts))
    for found in names:
        at = _among(found, stems)
        if len(weights):
            weight = np.maximum(weight, np.where(at >= 0, weights[at], 0.0))
    hostile = insult | (weight > 0)
    yous = np.concatenate(([0], np.cumsum(you)))
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    here = np.arange(len(starts))
    near = yous[np.minimum(here + NEAR + 1, first[1:][row])] - yous[np.maximum(here - NEAR, first[:-1][row])]
    letters, capitals = per_row(_LETTER[data], offs), per_row(_CAPITAL[data], offs)
    caps = np.concatenate(([0], np.cumsum(_CAPITAL[data])))
    shouted = (caps[ends] - caps[starts] == ends - starts) & (ends - starts > 2)
    masked = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        masked[1:-1] = _LETTER[data[:-2]] & _MASK[data[1:-1]] & _LETTER[data[2:]]
    words = np.maximum(np.diff(first), 1)
    size = np.maximum(np.diff(offs), 1)
    return np.column_stack(
        [
            per_row(insult) / words,
            np.log1p(per_row(insult)),
            per_row(weight > 0) / words,
            np.log1p(per_row(weight > 0)),
            per_row(weight) / words,
            per_row(hostile & (near > 0)) / words,
            per_row(you) / words,
            capitals / np.maximum(letters, 1),
            per_row(shouted) / words,
            per_row(data == 0x21, offs) / size,
            per_row(data == 0x3F, offs) / size,
            per_row(_MARKS[data], offs) / size,
            per_row(masked, offs) / words,
            np.log1p(np.diff(first)),
        ]
    )


def _learn_stems(sampled: DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and stems that texts of label 1 hold far more often: sorted names and weights, at most ``LEXICON_SIZE``."""

    def run(batches):
        for whole in batches:
            for batch in steps(whole, "text"):
                data, offs = text_buffer(batch.column("text"))
                starts, ends, first = _runs(data, offs)
                names = np.column_stack(_names(_TO_LOWER[data], starts, ends))
                toxic = batch.column("label").to_numpy(zero_copy_only=False) == 1
                own = [np.unique(names[first[i] : first[i + 1]]) for i in range(batch.num_rows)]
                every, where = np.unique(np.concatenate(own), return_inverse=True)
                bad = np.bincount(where, weights=np.repeat(toxic, [len(o) for o in own]), minlength=len(every))
                both = np.bincount(where, minlength=len(every))
                yield pa.record_batch(
                    [pa.array(every.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array(both)], names=["name", "bad", "n"]
                )

    counted = sampled.select("text", "label").mapInArrow(run, "name long, bad long, n long")
    summed = counted.groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).filter("name != 0")
    share = n_toxic / (n_toxic + n_clean)
    bad_rate, rate = F.col("bad") / n_toxic, (F.col("n") - F.col("bad") + 0.5) / n_clean
    # log-likelihood of the counts against independence of the label
    part = F.col("bad") / F.col("n")
    rest = F.when(part < 1, (F.col("n") - F.col("bad")) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    evidence = F.col("bad") * F.log(part / share) + rest
    chosen = (
        summed.filter("bad > 2")
        .select("name", evidence.alias("evidence"), F.log(bad_rate / rate).alias("weight"))
        .filter((F.col("evidence") > LEAST_EVIDENCE) & (F.col("weight") > math.log(8)))
        .orderBy(F.desc("evidence"), "name")
        .limit(LEXICON_SIZE)
        .collect()
    )
    names = np.array([r["name"] for r in chosen], dtype=np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.array([r["weight"] for r in chosen])[order]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def _featured(rows: DataFrame, stems: np.ndarray, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``rows`` with the ``FEATURES`` of a text, which itself stays only under another name than ``text``."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches):
        for whole in batches:
            for batch in steps(whole, text):
                values = dense_features(batch.column(text), stems, weights)
                yield pa.record_batch([*(batch.column(c) for c in others), *(pa.array(v) for v in values.T)], names=[*others, *FEATURES])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in others] + [f"{name} double" for name in FEATURES]
    return rows.mapInArrow(run, ", ".join(kinds))


def _fitted(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows_per_class: int
) -> Callable[..., DataFrame]:
    """Learn from the labelled rows of ``docs``; the result adds a ``score`` to any rows by the text that it is told, task by task,
    and leaves out a column ``text``."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.filter(~held_out(F.col("doc_id")))
    chance = F.xxhash64("doc_id")
    toxic = known.filter("label = 1").orderBy(chance, "doc_id").limit(rows_per_class)
    clean = known.filter("label = 0").orderBy(chance, "doc_id").limit(rows_per_class)
    sample = stash(toxic.union(clean).coalesce(1))
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)

    def constant(score: float) -> Callable[..., DataFrame]:
        return lambda rows, _="text": rows.drop("text").withColumn("score", F.lit(score))

    if not n_toxic or not n_clean:
        return constant(1.0 if n_toxic else 0.0)
    sampled = stash(_plain(docs, key, text).join(F.broadcast(sample), "doc_id").select("text", "label"))
    stems, weights = _learn_stems(sampled, n_toxic, n_clean)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = assembler.transform(_featured(sampled, stems, weights)).select("features", "label").coalesce(4)
    if not train.take(1):
        return constant(n_toxic / (n_toxic + n_clean))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, maxBins=64, seed=17).fit(train)

    def probability(rows: DataFrame) -> DataFrame:
        return trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])

    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(
        probability(train).select("raw", F.col("label").cast("double").alias("label"))
    )

    def scored(rows: DataFrame, text: str = "text") -> DataFrame:
        found = calibration.transform(probability(assembler.transform(_featured(rows, stems, weights, text))))
        score = F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)).alias("score")
        return found.select(*[c for c in rows.columns if c != "text"], score)

    return scored


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score`` between 0 and 1, ``predicted``.

    Labels are learned only from rows outside the held-out fold (crc32 of the key as text, modulo 5). A bounded sample of them
    fits the lexicon of stems, the trees and the calibration; every text is scored from its own characters alone. Null and
    empty texts have features of zero and a score like others. A key labelled twice counts as toxic if any label says so;
    labels without a key or value are ignored; a null key is scored and not held out. With labels of one class or none, every
    score is the share of label 1 among them (0 without labels). An empty table gives no rows; other columns are not read.
    """
    scored = _fitted(docs, labels, key, text, label, rows_per_class)(_plain(docs, key, text))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; rows that share a key go if any of them is, rows with a null key stay.

    A row is judged in the task that reads it, so texts are not shuffled; only keys are, to find those of several rows.
    """
    fitted = _fitted(docs, labels, key, text, label, rows_per_class)
    columns = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]  # any column names are fine
    rows = docs.select(*columns, docs[key].alias("k"), docs[text].cast("string").alias("text"))
    if docs.schema[text].dataType.simpleString() == "string":  # then the text need not travel twice
        scored = fitted(rows.drop("text"), f"c{docs.columns.index(text)}")
    else:
        scored = fitted(rows)
    kept = scored.filter("score < 0.5 or k is null")
    repeated = stash(docs.select(docs[key].alias("k")).filter("k is not null").groupBy("k").count().filter("count > 1").select("k"))
    if not repeated.isEmpty():
        own = fitted(docs.select(docs[key].alias("k"), docs[text].cast("string").alias("text")).join(repeated, "k", "left_semi"))
        bad = stash(own.filter("score >= 0.5").select(F.col("k").alias("bad")).distinct())
        kept = kept.join(bad, kept["k"] == bad["bad"], "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
