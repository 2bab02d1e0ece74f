import math
import random
from collections import Counter

from markwell.operators import keywords as W

WORDS = [f"word{k}" for k in range(40)] + ["the", "ab", "и", "слово"]


def sample(n):
    dice = random.Random(3)
    return [(k, " ".join(dice.choice(WORDS[: 4 + k % 40]) for _ in range(dice.randrange(30)))) for k in range(n)] + [(n, None), (n + 1, "слово the слово")]


def test_tfidf_reads_each_text_once(spark):
    """Against the definition; short texts come from the same pass as long ones."""
    rows = sample(80)
    out = W.tfidf_keywords(spark.createDataFrame(rows, "k long, t string").repartition(3), "k", "t", 5)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    expected = set()
    for k, text in rows:
        tokens = [w for w in (text or "").split() if len(w) > 2 and w != "the"]
        if len(text or "") < 10:
            continue
        if len(tokens) < 3:
            expected |= {(k, p + 1, w, None) for p, (w, _) in enumerate(Counter(tokens).most_common(5))}
            continue
        counts = Counter(tokens) + Counter(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))
        ranked = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:10]
        norm = math.sqrt(sum(n * n for _, n in ranked))
        expected |= {(k, p + 1, w, round(n / norm, 9)) for p, (w, n) in enumerate(ranked[:5])}
    assert {(r.k, r.place, r.keyword, r.weight and round(r.weight, 9)) for r in out.collect()} == expected


def test_corpus_tfidf_leaves_out_only_words_that_cannot_lead(spark, monkeypatch):
    """Against the definition, with few words known to the tasks (all others are joined), and with all of them."""
    rows = sample(60)
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    counts = {k: Counter(w for w in (t or "").split() if len(w) > 2 and w != "the") for k, t in rows}
    texts = Counter(w for c in counts.values() for w in c)
    expected = set()
    for k, c in counts.items():
        weights = {w: m * math.log(len(rows) / texts[w]) for w, m in c.items()}
        ranked = sorted(weights, key=lambda w: (-round(weights[w], 9), w))[:4]
        expected |= {(k, p + 1, w, round(weights[w], 6)) for p, w in enumerate(ranked)}
    for hot in (6, 50_000):
        monkeypatch.setattr(W, "HOT_WORDS", hot)
        out = W.corpus_tfidf(df, "k", "t", 4)
        assert {(r.k, r.place, r.keyword, round(r.weight, 6)) for r in out.collect()} == expected


def test_corpus_tfidf_ranks_only_words_that_can_lead(spark):
    """Words known to the tasks are cut in their text: no join of their rows, and the ranking reads a bounded number of them."""
    assert W.leading([(-1.0, "d"), (-1.0, "c"), (-2.0, "z"), (-1.0 + 1e-9, "a"), (-0.5, "b")], 2) == [
        (-2.0, "z"), (-1.0, "c"), (-1.0, "d"), (-1.0 + 1e-9, "a")
    ]
    assert len(W.leading([(-1.0, f"w{k}") for k in range(900)], 3)) == 3
    rows = [(k, " ".join(f"word{(k * 7 + j) % 300}" for j in range(200))) for k in range(40)]
    out = W.corpus_tfidf(spark.createDataFrame(rows, "k long, t string"), "k", "t", 3)
    assert out.count() == 3 * len(rows)
    ranked = out._jdf.queryExecution().optimizedPlan().toString()
    assert ranked.count("Join") == 1  # that of words unknown to the tasks
