import random

import pytest
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions import charcounts
from markwell.functions import scoring as S
from markwell.functions import style


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", 0.0),
        ("   ", 0.0),
        ("1. А", 0.05),
        ("1. А 2. Б 3. В 4. Г 5. Д", 0.2),
        ("• a", 0.05),
        ("• a • b • c", 0.10),
        ("• a • b • c • d", 0.15),
        ("*" * 11, 0.2),
        ("Следует отметить", 0.1),
        ("следует отметить, важно отметить, таким образом", 0.3),
        ("Итог: раз", 0.05),
        ("Итог: раз\nВывод: два\nЕще: три", 0.05),  # one greedy match
        ("Итог: раз.\nВывод: два.\nЕще: три", 0.1),
        ("во-первых и во-вторых", 0.1),
        ("x" * 99 + "\n", 0.0),
        ("x" * 98 + "\nx", 0.05),
    ],
)
def test_llm_likelihood(one, text, expected):
    assert one(style.llm_likelihood, text) == pytest.approx(expected)


def test_special_and_punctuation(one):
    s = one(style.special_characters, "привет 😀 — ok «q»")
    assert (s.has_emoji, s.has_long_dash, s.has_special_unicode, s.special_chars_count) == (True, True, True, 4)
    p = one(style.punctuation_errors, "Раз,два.  три. Четыре! пять")
    assert (p.missing_spaces_after_punctuation, p.double_spaces, p.missing_capitalization, p.total_errors) == (1, 1, 2, 4)


def test_readability(one):
    assert one(style.readability, "short") == 0.0
    assert one(style.readability, "The cat sat. The dog ran.") == pytest.approx(206.835 - 1.015 * 3 - 84.6 * 1)


def test_reference_f1(one):
    f1 = one(lambda c: style.reference_f1(F.col(c), ["alpha beta gamma", "delta"]), "alpha beta beta omega")
    p, r = 3 / 4, 2 / 3
    assert f1 == pytest.approx(2 * p * r / (p + r))
    assert one(lambda c: style.reference_f1(F.col(c), ["x"]), "") == 0.0


@pytest.mark.parametrize("sim, score", [(0.45, 1.0), (0.90, 10.0), (0.675, 5.0), (-1.0, 1.0), (1.0, 10.0), (None, None)])
def test_cosine_to_score(one, sim, score):
    assert one(S.cosine_to_score, sim, "double") == score


def test_cosine_to_score_repairs_bounds(one):
    assert one(lambda c: S.cosine_to_score(c, 0.9, 0.45), 0.95, "double") == 10.0


@pytest.mark.parametrize("a, k, delta", [(70, 70, 0.0), (134, 70, 0.4), (150, 70, 0.5), (10, 70, -0.9), (0, 70, 0.0), (500, 70, 0.5)])
def test_length_adjustment(spark, a, k, delta):
    df = spark.createDataFrame([(a, k)], "a int, k int").select(S.length_delta(S.length_ratio("a", "k")).alias("d"))
    assert df.first()["d"] == pytest.approx(delta)


def test_round_half_is_on_the_binary_value(one):
    assert one(lambda c: S.round_half(c, 2), 4.145, "double") == 4.14
    assert one(lambda c: S.round_half(c, 1), -0.25, "double") == -0.3


def test_uncertainty_and_concreteness(one):
    assert one(S.uncertainty_hits, "я не уверен возможно") == 3  # two patterns see "не уверен"
    assert one(S.uncertainty_hits, "невозможно") == 0
    assert one(S.concreteness_coverage, "нужен индекс и primary key int") == 3


def test_penalties_and_bands(spark):
    df = spark.createDataFrame([(9.0, 4, 0, 5), (9.0, 0, 1, 5), (9.0, 0, 0, 0)], "b double, h int, c int, n int")
    assert [r[0] for r in df.select(S.quality_penalties("b", "h", "c", "n")).collect()] == [5.9, 9.0, 9.0]
    bands = spark.createDataFrame([(8.5,), (6.0,), (4.0,), (3.9,), (None,)], "s double").select(S.grade_band("s")).collect()
    assert [r[0].split()[0] for r in bands] == ["Ответ", "Ответ", "Частичное", "Низкое", "Нет"]


@pytest.mark.parametrize(
    "words, marks, expected", [(10, 1, 1.5), (20, 1, 1.5), (5, 1, 1.0), (30, 1, 1.0), (31, 1, 0.5), (4, 1, 0.5)]
)
def test_quality_structure(one, words, marks, expected):
    text = "слово " * words + "." * marks
    n = words + 1  # the lone mark counts as a word
    shift = {10: 11, 20: 21}.get(words)
    got = one(lambda c: S.quality_score(c, F.lit(0.0)), text.replace(" .", "."))
    assert got == pytest.approx(expected), (n, shift)


def test_scores(spark):
    row = spark.range(1).select(
        S.anti_cheating_score(F.lit(0.5), F.lit(0)).alias("a"),
        S.anti_cheating_score(F.lit(None).cast("double"), F.lit(None).cast("int")).alias("b"),
        S.logic_score(F.lit("a. b. c."), F.lit(0.5), F.lit(0.5)).alias("c"),
        S.originality_score(F.lit(0.9), F.lit(1.0)).alias("d"),
        S.auto_task_score(F.lit(1.0), F.lit(3.0), F.lit(2.0)).alias("e"),
    ).first()
    assert [row.a, row.b, row.c, row.d, row.e] == pytest.approx([1.2, 1.0, 65.0, 0.0, 10.0])


def test_reference_f1_of_counts_words_once(spark):
    """Against the definition, with repeats, null words and lists; no plan compares every word with every reference."""
    refs = [["alpha", "beta", "beta", None], [], ["Beta"], ["gamma", "delta"]]
    rows = [("Alpha beta beta, omega!", refs), ("delta", refs), ("", refs), (None, refs), ("alpha", None), ("omega", [])]
    df = spark.createDataFrame(rows, "t string, r array<array<string>>").repartition(3)
    scored = df.select("t", "r", style.reference_f1_of("t", "r").alias("f"))

    def brute(text, references):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        best = 0.0
        for ref in references or []:
            if words and ref:
                p, r = sum(w in ref for w in words) / len(words), sum(w in words for w in ref) / len(ref)
                best = max(best, 2 * p * r / (p + r) if p + r else 0.0)
        return best

    assert all(row.f == brute(row.t, row.r) for row in scored.collect())
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan


def test_counts_and_habits_equal_their_patterns(spark):
    """All counts over characters against the regular expressions that define them, on texts of awkward characters."""
    dice = random.Random(5)
    odd = list("aeZАяёИ İıſ\n\t\xa0\x1c .!?,;:--–—_7٣Ⅷ😀✂\U0001d400«»()*é") + [". ", "  ", "! ", "в ", "ᲀ соответствии с ", "во-первых", "VO-", "wıth regard to"]
    texts = ["", " ", "İa", "a. ", "a.  B. \x85c", "x" * 12] + ["".join(dice.choice(odd) for _ in range(dice.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    t, sp, wd = F.col("t"), K.SPACE_CLASS, K.WORD_CLASS
    later = F.slice(F.split(t, f"[.!?][{sp}]+"), F.lit(2), F.size(F.split(t, f"[.!?][{sp}]+")))
    patterns = {
        "words": f"[{wd}]+", "sentences": "[.!?]+", "marks": "[.!?]", "tokens": f"[^{sp}]+", "emoji": f"[{K.EMOJI_CLASS}]", "dashes": "[—–]",
        "odd": rf"[^{wd}{sp}.,;:!?\-()\[\]{{}}\x22\x27]", "tight": "[.,;:!?][А-Яа-яA-Za-z]", "doubles": "  +",
    }
    expected = {k: style.hits(t, p) for k, p in patterns.items()} | {
        "syllables": style.hits(F.lower(t), f"[{charcounts.VOWELS}]+"),
        "lower_starts": F.size(F.filter(later, lambda s: (F.length(s) > 0) & ~s.rlike(r"^\p{Lu}"))),
    }
    habits = F.array(*[t.rlike("(?iu)" + p.replace(r"\s", f"[{sp}]")) for p in K.FORMAL_PATTERNS])
    quick = F.array(*[style._formal(t, F.lower(t), t.rlike(style.FOLDED), p) for p in K.FORMAL_PATTERNS])
    n = charcounts.char_counts(t)
    rows = df.select(t, F.array(*[n[k] for k in charcounts.FIELDS]).alias("n"), F.array(*[expected[k] for k in charcounts.FIELDS]).alias("e"), habits.alias("h"), quick.alias("q"))
    found = rows.collect()
    assert [(r.t, r.n, r.q) for r in found] == [(r.t, r.e, r.h) for r in found] and len(found) == len(texts)
    assert any(any(r.h) for r in found)


def test_metrics_of_a_text_share_one_pass(spark):
    df = spark.createDataFrame([("A b.",), (None,)], "t string").select("t", style.analyze_text("t").alias("m"))
    scored = df.select("m.*", S.quality_score("t", F.col("m.readability")))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [char_counts") == 1


def test_auto_task_score_evaluates_the_likelihood_once(spark):
    df = spark.createDataFrame([("A b.",)], "t string")
    m = df.select("t", style.analyze_text("t").alias("m")).select("t", "m.readability", "m.llm_likelihood", "m.punctuation_errors.total_errors")
    score = S.auto_task_score(F.lit(0.5), S.quality_score("t", "readability"), S.anti_cheating_score("llm_likelihood", "total_errors"))
    plan = m.select(score)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("named_struct(low") + plan.count("struct(low") == 1
