"""Keywords by frequency and by n-gram weight."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions import text as T
from markwell.functions.text import let
from markwell.operators.generate import exploded, numbered, settled
from markwell.session import cut_lineage


POSITIONS = 1 << 31  # more than the words of any one text


# Words whose numbers of texts are broadcast; the rows of all others are joined by a shuffle.
HOT_WORDS = 50_000
# More than the difference of two weights that are equal once rounded to nine decimals.
ROUNDING = 2e-9


def _term_counter(pairs: bool = False, limit: int | None = None):
    """A function of normalized texts: (tokens, terms, counts).

    Terms are the distinct usable words, in no order. With ``pairs`` those of neighbours are terms too, and all go by falling count,
    ties alphabetical; only a text of fewer than three usable words keeps to its words, ties by first appearance.
    """
    stop = frozenset(K.RUSSIAN_STOP_WORDS + K.ENGLISH_STOP_WORDS)

    @F.pandas_udf("tokens int, terms array<string>, counts array<int>")
    def term_counts(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            tokens = [w for w in text.split() if len(w) > 2 and w not in stop]
            counted = Counter(tokens)
            if pairs and len(tokens) < 3:
                ranked = counted.most_common()
            elif pairs:
                counted.update(map(" ".join, zip(tokens, tokens[1:])))
                ranked = sorted(counted.items(), key=lambda e: (-e[1], e[0]))
            else:
                ranked = list(counted.items())
            ranked = ranked[:limit]
            rows.append((len(tokens), [e[0] for e in ranked], [e[1] for e in ranked]))
        return pd.DataFrame(rows, columns=["tokens", "terms", "counts"])

    return term_counts


def _words(df: DataFrame, keys: list[str], text: str, order: str | None) -> DataFrame:
    lowered = F.regexp_extract_all(F.lower(text), F.lit(f"[{K.WORD_CLASS}]+"), F.lit(0))
    stop = [w for w in K.RUSSIAN_STOP_WORDS + K.ENGLISH_STOP_WORDS if len(w) > 2]
    cols = [*keys, *([order] if order else [])]
    return numbered(df, cols, lowered, "pos", "word").filter((F.length("word") > 2) & ~F.col("word").isin(*stop))


def keyword_frequency(df: DataFrame, keys: list[str], text: str, n: int, order: str) -> DataFrame:
    """The ``n`` most frequent words per group, ties by first appearance (``order``, then position).

    Counts combine map-side; the rank keeps at most n rows per task before its shuffle. ``order`` is any bigint: it is
    packed with the word position into one wide decimal, which keeps the hash aggregation.
    """
    seen = F.col(order).cast("decimal(20,0)") * F.lit(POSITIONS).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    counted = _words(df, keys, text, order).groupBy(*keys, "word").agg(
        F.count("*").alias("n"), F.min(seen).alias("first_seen")
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("first_seen"))
    return counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("first_seen")


def tfidf_keywords(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Top words and word pairs of each text by weight: (key, place, keyword, weight).

    With one document per vocabulary the inverse document frequency is constant, so the weight is the
    L2-normalised count over the 2n most frequent features (ties alphabetical). Texts of fewer than three
    usable tokens fall back to plain word counts; texts under ten characters give nothing.
    """
    clean = settled(df.select(key, T.normalize_strip_punct(text).alias("_t"))).filter(F.length("_t") >= 10)
    found = settled(clean.select(key, _term_counter(pairs=True, limit=2 * n)("_t").alias("_f")))
    features = F.transform("_f.terms", lambda term, i: F.struct((-F.get("_f.counts", i)).alias("neg"), term.alias("keyword")))

    def weigh(fs):
        norm = F.sqrt(F.aggregate(fs, F.lit(0.0), lambda s, f: s + f["neg"] * f["neg"]))
        return let(
            norm,
            lambda z: F.transform(
                F.slice(fs, 1, n),
                lambda f, i: F.struct(
                    (i + 1).alias("place"), f["keyword"].alias("keyword"), F.when(F.col("_f.tokens") >= 3, -f["neg"] / z).alias("weight")
                ),
            ),
        )

    return found.select(key, F.inline_outer(let(features, weigh))).filter("place IS NOT NULL")


def keywords_per_task(answers: DataFrame, n: int = 15) -> DataFrame:
    """(doc_id, task_number, keywords) for tasks 1..4 of every document (or set of reference answers).

    A short or missing text gives an empty list.
    """
    keyed = answers.select(F.struct("doc_id", "task_number").alias("key"), "content")
    lists = tfidf_keywords(keyed, "key", "content", n).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("place", "keyword"))).alias("found")  # at most n entries
    )
    found = lists.select("key.*", F.transform("found", lambda e: e["keyword"]).alias("keywords"))
    rows = answers.select("doc_id", "task_number").join(found, ["doc_id", "task_number"], "left")
    wide = rows.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("task_number") == k, F.col("keywords"))).alias(f"k{k}") for k in K.TASKS]
    )
    empty = F.array().cast("array<string>")
    slots = F.array(
        *[F.struct(F.lit(k).alias("task_number"), F.coalesce(F.col(f"k{k}"), empty).alias("keywords")) for k in K.TASKS]
    )
    return wide.select("doc_id", F.inline_outer(slots))


def leading(weighted: list[tuple[float, str]], n: int) -> list[tuple[float, str]]:
    """Of ``(-weight, word)`` all that can be among the ``n`` first by rounded weight, ties alphabetical.

    Weights that round alike differ by less than ``ROUNDING``; of words with one weight the ``n`` first suffice.
    """
    weighted.sort()
    if len(weighted) <= n:
        return weighted
    last, run, kept = None, 0, []
    for entry in weighted:
        if entry[0] > weighted[n - 1][0] + ROUNDING:
            break
        run = run + 1 if entry[0] == last else 1
        last = entry[0]
        if run <= n:
            kept.append(entry)
    return kept


def _leader_finder(known, n: int):
    """A function of (terms, counts): the words that can lead among the ``known`` ones, and all other words with their counts."""

    @F.pandas_udf("keywords array<string>, weights array<double>, others array<string>, counts array<int>")
    def leaders(terms: pd.Series, counts: pd.Series) -> pd.DataFrame:
        rarity, rows = known.value, []
        for words, numbers in zip(terms, counts):
            weighted, others = [], []
            for word, count in zip(words, numbers.tolist()):
                if (rare := rarity.get(word)) is None:
                    others.append((word, count))
                else:
                    weighted.append((-count * rare, word))
            lead = leading(weighted, n)
            rows.append(([e[1] for e in lead], [-e[0] for e in lead], [e[0] for e in others], [e[1] for e in others]))
        return pd.DataFrame(rows, columns=["keywords", "weights", "others", "counts"])

    return leaders


def corpus_tfidf(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Top ``n`` words of each text by count x ln(texts / texts with the word): (key, place, keyword, weight), ties alphabetical.

    Words are counted inside their text. Words that a large part of the texts hold, a bounded number, are known to the tasks: there each
    text keeps those of them that can lead, so only these and its other words are joined and ranked. A word of all texts weighs 0.
    """
    found = cut_lineage(settled(df.select(key, _term_counter()(T.normalize_strip_punct(text)).alias("_f"))))
    rarity = F.ln(F.lit(float(found.count())) / F.col("_df"))
    found = found.filter(F.size("_f.terms") > 0)
    words = exploded(found, [], F.col("_f.terms"), "keyword")
    texts = cut_lineage(words.groupBy("keyword").agg(F.count("*").alias("_df")))
    hot = texts.orderBy(F.desc("_df"), "keyword").limit(HOT_WORDS).select("keyword", rarity.alias("rarity")).toPandas()
    known = df.sparkSession.sparkContext.broadcast(dict(zip(hot["keyword"], hot["rarity"].tolist())))
    split = settled(found.select(key, _leader_finder(known, n)(F.col("_f.terms"), F.col("_f.counts")).alias("_s")))
    split = cut_lineage(split.select(key, "_s.*"))
    lead = split.select(key, F.inline_outer(F.arrays_zip(F.col("keywords").alias("keyword"), F.col("weights").alias("weight"))))
    rest = split.filter(F.size("others") > 0).select(
        key, F.inline_outer(F.arrays_zip(F.col("others").alias("keyword"), F.col("counts").alias("n")))
    )
    rest = rest.join(texts, "keyword").select(key, "keyword", (F.col("n") * rarity).alias("weight"))
    weighted = lead.filter("keyword IS NOT NULL").unionByName(rest)
    w = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), F.asc("keyword"))
    return weighted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select(key, "place", "keyword", "weight")
