"""License scan by ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwell.llm.common import lower_ascii
from markwell.llm.license_rules import STEMS, rules

# Phrases that are always counted, and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_CONFIDENCE = 0.5

# A match of any rule has at most so many words; it bounds how far a containing match can begin before a contained one.
WIDEST = 40
OPEN, CLOSE = "\x01", "\x02"

_DETECTION = "array<struct<start:int,stop:int,priority:int,rule:int,label:string,confidence:double>>"


def normal_words(text: Column) -> Column:
    """The words, A-Z lower-cased, each between single spaces; a single space if there are none."""
    flat = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(flat == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), flat, F.lit(" ")))


def words_in(norm: Column) -> Column:
    return (F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1).cast("long")


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _rule_table() -> Column:
    """The rules as one array; written as SQL text, it is folded into a constant."""
    table = [
        f"named_struct('gates', array({', '.join(f"' {g}'" for g in gates.split('|'))}), 'regex', r' ((?:{regex}))(?= )', "
        f"'label', '{label}', 'priority', {priority}, 'confidence', {confidence}D, 'rule', {number})"
        for number, (label, regex, gates, priority, confidence) in enumerate(rules())
    ]
    return F.expr(f"array({', '.join(table)})")


def _numbers_where(words: Column, test) -> Column:
    """Positions of the words that pass."""
    return F.filter(F.transform(words, lambda word, i: F.when(test(word), i)), lambda i: i.isNotNull())


def _places(norm: Column, phrase: str) -> Column:
    """Word positions where a phrase begins."""
    marked = F.split(F.trim(F.regexp_replace(norm, f" ({phrase})(?= )", f" {OPEN}$1")), " ", -1)
    return _numbers_where(marked, lambda word: F.startswith(word, F.lit(OPEN)))


def _detections(norm: Column) -> Column:
    """Matches of every rule whose gate is in the text and whose regex is found: marks are set around each match, then the
    positions of the marked words are read off."""
    # A gate is a prefix of a word, so it follows a space.
    hits = F.filter(_rule_table(), lambda r: F.exists(r["gates"], lambda g: F.contains(norm, g)))
    hits = F.filter(hits, lambda r: F.rlike(norm, r["regex"]))

    def of_rule(r: Column) -> Column:
        marked = F.split(F.trim(F.regexp_replace(norm, r["regex"], F.lit(f" {OPEN}$1{CLOSE}"))), " ", -1)
        return F.zip_with(
            _numbers_where(marked, lambda word: F.startswith(word, F.lit(OPEN))),
            _numbers_where(marked, lambda word: F.endswith(word, F.lit(CLOSE))),
            lambda a, b: F.struct(
                a.alias("start"),
                (b + 1).alias("stop"),
                r["priority"].alias("priority"),
                r["rule"].alias("rule"),
                r["label"].alias("label"),
                r["confidence"].alias("confidence"),
            ),
        )

    return F.array_sort(F.flatten(F.transform(hits, of_rule)))


def _suppressed(found: Column, n_rules: int) -> Column:
    """Drop each match that lies inside another of a better priority, or of the same priority and longer, or of the same span and
    an earlier rule. Matches are in order of their start, a rule begins at most once per word, and no match is wider than
    ``WIDEST`` words, so only a bounded stretch around a match can hold such another."""
    reach = (WIDEST + 1) * n_rules

    def beaten(d: Column, i: Column) -> Column:
        near = F.slice(found, F.greatest(i + 1 - reach, F.lit(1)), 2 * reach + 1)

        def wins(e: Column) -> Column:
            around = (e["start"] <= d["start"]) & (e["stop"] >= d["stop"]) & (e["rule"] != d["rule"])
            longer = e["stop"] - e["start"] > d["stop"] - d["start"]
            same = (e["start"] == d["start"]) & (e["stop"] == d["stop"])
            return around & (
                (e["priority"] < d["priority"])
                | ((e["priority"] == d["priority"]) & (longer | (same & (e["rule"] < d["rule"]))))
            )

        return F.exists(near, wins)

    return F.filter(found, lambda d, i: ~beaten(d, i))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``n_words``, ``places`` of base phrases ``(start, label)``, ``detections`` that stand after
    suppression, ``labels`` and a ``score``.

    Rules are tried in a text only behind two gates: a stem that some rule needs, then the rule's own keyword. Base phrases are
    counted at all their places and their labels always stay. The score is the highest confidence found, 0 if nothing is.
    Null or empty text: no words, nothing found. Repeated rows and null keys stay as they are; an empty table gives no rows;
    other columns are not read. Work is linear in the length of a text.
    """
    gate = F.rlike(F.col("norm"), F.lit(" (?:" + "|".join(STEMS) + ")"))
    base_gate = F.lit(False)
    for phrase, _ in BASE_PHRASES:
        base_gate = base_gate | F.contains(F.col("norm"), F.lit(f" {phrase} "))
    places = F.concat(
        *[
            F.when(
                F.contains(F.col("norm"), F.lit(f" {phrase} ")),
                _labelled(_places(F.col("norm"), phrase), label),
            ).otherwise(F.array().cast("array<struct<start:int,label:string>>"))
            for phrase, label in BASE_PHRASES
        ]
    )
    table = docs.select(F.col(key).alias("doc_id"), normal_words(F.col(text).cast("string")).alias("norm"))
    found = table.select(
        "doc_id",
        words_in(F.col("norm")).alias("n_words"),
        F.when(base_gate, places).otherwise(F.array().cast("array<struct<start:int,label:string>>")).alias("places"),
        F.when(gate, _detections(F.col("norm"))).otherwise(F.array().cast(_DETECTION)).alias("found"),
    )
    kept = found.withColumn("detections", F.when(F.size("found") > 0, _suppressed(F.col("found"), len(rules()))).otherwise(F.col("found")))
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return kept.select(
        "doc_id",
        "n_words",
        "places",
        "detections",
        base_labels.alias("base_labels"),
        labels.alias("labels"),
        F.greatest(best, F.when(F.size("places") > 0, F.lit(BASE_CONFIDENCE)).otherwise(0.0)).alias("score"),
    )
