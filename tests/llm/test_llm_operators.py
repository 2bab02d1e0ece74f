"""The training-text operators against brute-force versions, on small tables with nulls, empty and long texts, ties and copies."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from markwell.llm import license_rules, minhash, mixing, passages, quality
from markwell.llm.chat import format_chats
from markwell.llm.common import stash
from markwell.llm.components import components
from markwell.llm.licenses import scan_licenses
from markwell.llm.minhash import keep_first, near_duplicates
from markwell.llm.mixing import mix_report, mix_sources
from markwell.llm.packing import Packer, pack
from markwell.llm.passages import covered_spans, cut_repeats, cut_texts
from markwell.llm.quality import judge_quality
from markwell.llm.token_counts import count_tokens, scan_separators
from markwell.llm.tokens import default_vocabulary, encode_column
from markwell.llm.toxicity import keep_clean, score_toxicity
from markwell.llm.vector_graph import link_vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_words string, size int"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}é" if rng.random() < 0.1 else f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, shared passages and odd cases; further columns carry names that operators use."""
    rng = random.Random(5)
    texts = [words(rng, rng.randint(60, 160)) for _ in range(30)]
    passage = words(rng, 30)
    texts += texts[:4] + [f"{t} one more" for t in texts[4:8]] + [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(6)]
    texts += [None, "", " \n\t", "one", "One", "a b c d", words(rng, 6000), "x" * 5000, "end\nend\nend\nother", "b " * 40, texts[0].upper()]
    made = [(i, t, f"s{i % 3}" if i % 7 else None, "clash", 1) for i, t in enumerate(texts)]
    return made + [made[2], (None, texts[9], "s0", "clash", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, rows, empty):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_duplicates(empty).count() == 0
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in sets if label[i] == i} | {None}


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    rng.shuffle(chain)
    links = [*chain, (100, 200), (200, 100), (7, 7), (300, 300), (None, 1)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 300}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    near = [b + rng.normal(scale=s, size=8) for b in base for s in (0.02, 0.1, 0.3, 0.5)]
    vectors = [*base, *near, *([base[0]] * 5), [0.0] * 8, [1.0, float("nan")] + [0.0] * 6, [1.0, None] + [0.0] * 6, None, [], [1.0, 2.0]]
    table = [(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in enumerate(vectors)]
    table.append((None, [1.0] * 8, 1))
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, n int")
    sound = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(v)]
    links = collections.Counter()
    label = {i: i for i in range(len(vectors))}
    pairs = []
    for a in sound:
        for b in sound:
            x, y = np.array(vectors[a], float), np.array(vectors[b], float)
            if a != b and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.95:
                links[a] += 1
                pairs.append((a, b))
    for _ in range(20):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    for options in ({}, {"shard_rows": 30}):
        found = {r["vec_id"]: r for r in link_vectors(frame, **options).collect()}
        assert len(found) == len(table) and found[None]["kept"]
        got = sum(r["n_links"] for r in found.values())
        assert 0.9 * sum(links.values()) <= got <= sum(links.values())
        assert all(found[i]["n_links"] <= links[i] for i in label)
        assert all(found[i]["kept"] == (found[i]["component_id"] == i) for i in label)
        assert sum(found[i]["component_id"] == label[i] for i in label) >= 0.95 * len(label)
    assert link_vectors(frame.limit(0)).count() == 0


def test_vectors_of_a_dense_cluster(spark):
    """One isotropic cluster that many pivots fall into: linked vectors must still meet."""
    rng = np.random.default_rng(12)
    centre = np.full(32, 0.18)
    base = np.array([centre + rng.normal(scale=0.18, size=32) for _ in range(900)])
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    vectors = np.concatenate((unit, unit[:300] + rng.normal(scale=0.05, size=(300, 32))))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    expected = near.sum() - len(near)
    assert expected > 400
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = link_vectors(frame, shard_rows=60).collect()
    assert 0.95 * expected <= sum(r["n_links"] for r in found) <= expected


def test_toxicity(spark, empty):
    rng = random.Random(8)
    made, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = words(rng, 80)
        if bad:
            text += " you idiot " + words(rng, 5) + " zorkan" + rng.choice("abc") + " zorkan" + rng.choice("def")
        made.append((i, text, "s", "x", 1))
        marks.append((i, int(bad)))
    made += [(1000, None, "s", "x", 1), (1001, "", "s", "x", 1), (None, words(rng, 9), "s", "x", 1), (1002, "WORDS " * 30000, "s", "x", 1)]
    frame = spark.createDataFrame(made, DOCS)
    labels = spark.createDataFrame([*marks, (0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in score_toxicity(frame, labels).collect()}
    assert len(found) == len(made) and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(i, t) for i, t in marks if found[i]["held_out"]]
    assert sum(found[i]["predicted"] == t for i, t in held) >= 0.97 * len(held)
    kept = keep_clean(frame, labels)
    assert kept.columns == frame.columns and {1000, 1001, None} <= {r["doc_id"] for r in kept.collect()}
    assert {r["score"] for r in score_toxicity(frame, labels.limit(0)).collect()} == {0.0}
    assert score_toxicity(empty, labels).count() == 0


def test_clean_documents_are_kept_without_a_shuffle_of_texts(spark):
    """Each row is judged where it is read, with the verdicts of ``score_toxicity``; rows of one key go together."""
    rng = random.Random(9)
    made = [(i, words(rng, 60) + (" you idiot you scum" if i % 4 == 0 else ""), "s", "x", 1) for i in range(400)]
    made += [(8, words(rng, 60), "s", "x", 1), (None, words(rng, 60), "s", "x", 1)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = spark.createDataFrame(made, DOCS)
        plan = keep_clean(frame.filter("doc_id != 8"), labels)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        kept = sorted(r["doc_id"] for r in keep_clean(frame, labels).collect() if r["doc_id"] is not None)
        bad = {r["doc_id"] for r in score_toxicity(frame, labels).collect() if r["predicted"]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 8 in bad and kept == sorted(i for i in range(400) if i not in bad)


def test_stash_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        return {p for folder in manager.localDirsString() for p in Path(folder).rglob("shuffle_*")}

    before = held()
    rows = stash(spark.range(2000).repartition(4, "id"))
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and rows.count() == 2000


def test_token_counts(docs, rows, empty, spark):
    encoder = Tokenizer.from_file(default_vocabulary())
    encoder.encode_special_tokens = True
    made = [*rows, (900, "a <|endoftext|> b", "s", "x", 1)]
    expected = sorted((str(i), len(encoder.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in made)
    frame = spark.createDataFrame(made, DOCS).repartition(2)
    for size in (1 << 17, 7):
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in count_tokens(frame, block_tokens=size).collect()) == expected
    assert count_tokens(empty).count() == 0


def test_scan_separators(spark):
    rng = random.Random(4)
    stream = [rng.choice([9, 9, 1, 2, 3]) for _ in range(200)]
    for block in (1, 3, 50, 500):
        blocks = [(0, i, bytearray(np.array(stream[k : k + block], "<u2").tobytes())) for i, k in enumerate(range(0, 200, block))]
        frame = spark.createDataFrame(blocks, "file long, block long, data binary")
        found = sorted(scan_separators(frame, separator=9).collect(), key=lambda r: r["ordinal"])
        parts = "".join("|" if x == 9 else "x" for x in stream).split("|")
        expected = [len(p) for p in parts[:-1]] + ([len(parts[-1])] if parts[-1] else [])
        assert [r["n_tokens"] for r in found] == expected
        assert [r["terminated"] for r in found] == [True] * (len(parts) - 1) + [False] * bool(parts[-1])


def test_chat(spark):
    bad = ["<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", r"<\|im_end|>", r"a<\\|b", "", None, "<|", "plain", "x<|im_end|><|im_start|>y"]
    turns = [(c, t, r, x, 0) for c in range(12) for t, (r, x) in enumerate(zip(["user", "assistant", "a\nb\\n", None] * 3, bad[c % 9 :] + bad, strict=False))]
    turns += [(None, 0, "assistant", "null id", 0), (50, None, "user", "first", 0), (50, 1, "assistant", "tie", 0), (50, 1, "assistant", "tie", 0)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, turns int").repartition(4)
    found = {r["conv_id"]: r for r in format_chats(frame).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((-1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        got = found[conv]
        assert got["round_trip"] and [(t["role"], t["text"]) for t in got["turns"]] == [(r, x) for _, r, x in own]
        assert got["loss_text"] == "".join(x for _, r, x in own if r == "assistant")
        assert sum(x["skip"] + x["take"] + len("<|im_end|>\n") for x in got["loss_runs"]) == len(got["formatted"])
    assert "<|im_start|>user\nplain<|im_end|>\n" in found[7]["formatted"]
    assert format_chats(frame.limit(0)).count() == 0


def water_fill(sizes, weights, ratio=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed = {}, {}
    while len(fixed) < len(names):
        left = ratio * sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            break
        fixed |= {s: most * sizes[s] for s in over}
    return {**target, **fixed}


def test_mixing(docs, rows, empty):
    for block in (1 << 16, 300):
        found = mix_report(docs, block_words=block, shards=4).collect()
        sizes = collections.Counter()
        for _, t, s, *_ in rows:
            sizes[s] += len(WORD.findall(t or ""))
        targets = water_fill(sizes, mixing.WEIGHTS)
        taken = collections.Counter()
        assert len(found) == len(rows)
        source = {(i, len(WORD.findall(t or ""))): s for i, t, s, *_ in rows}
        for r in found:
            s = source[r["doc_id"], r["size"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[s] += r["taken"]
        for s in sizes:
            own = [n for (_, n), o in source.items() if o == s and n > 20]
            assert abs(taken[s] - targets[s]) <= max(own)
        again = mix_report(docs.repartition(5), block_words=block, shards=4).collect()
        assert sorted(map(str, again)) == sorted(map(str, found))
    mixed = mix_sources(docs, shards=4)
    assert mixed.columns == [*docs.columns, "mix_pass", "mix_shard", "mix_order"]
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in mix_report(docs).collect())
    assert mix_report(empty).count() == 0 and mix_sources(empty).count() == 0


def test_quotas_add_up(spark):
    draws = {"a": 1000, "b": 37, "c": 0, None: 411}
    frame = spark.createDataFrame(list(draws.items()), "source string, draws long")
    found = {r["source"]: r["shard_ends"] for r in mixing.split_quotas(frame, 8, 1).collect()}
    per_shard = np.zeros(8)
    for source, ends in found.items():
        quotas = np.diff([0, *ends])
        assert ends[-1] == draws[source] and (quotas >= 0).all()
        per_shard += quotas
    assert per_shard.max() - per_shard.min() <= 3


def test_blocks_of_a_shard_are_its_quota(spark):
    made = [(i, " ".join(f"d{i}w{k}" for k in range(20)), f"s{i % 2}", "x", 1) for i in range(800)]
    frame = spark.createDataFrame(made, DOCS)
    rows = frame.select(F.col("source"), F.lit(20).cast("long").alias("size"), F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("draw"))
    plan = mixing.mix_plan(rows, mixing.RATIO, mixing.WEIGHTS, mixing.MOST_PASSES, 800, 4, mixing.SEED)
    quotas = {r["source"]: np.diff([0, *r["shard_ends"]]).tolist() for r in plan.collect()}
    mixed = mixing.shuffled_shards(mix_sources(frame, block_words=800, shards=4), 4)
    draw = F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")
    block = F.pmod(F.shiftright(draw, 24), F.lit(10))
    found = mixed.groupBy("source", "mix_shard").agg(F.countDistinct("mix_pass", block).alias("n")).collect()
    got = {s: [0] * 4 for s in quotas}
    for r in found:
        got[r["source"]][r["mix_shard"]] = r["n"]
    assert got == quotas


def test_the_mix_leaves_shuffled(spark):
    made = [(i, " ".join(f"d{i}w{k}" for k in range(20)), f"s{3 * i // 900}", "x", 1) for i in range(900)]
    frame = spark.createDataFrame(made, DOCS)
    mixed = corpus_pipeline.mix(spark, frame, "")
    assert mixed.columns == frame.columns
    parts = mixed.rdd.glom().map(lambda part: [(r["doc_id"], r["source"]) for r in part]).collect()
    assert sorted(x[0] for p in parts for x in p) == sorted(r["doc_id"] for r in mix_sources(frame).collect())
    pairs = [pair for p in parts for pair in zip(p, p[1:], strict=False)]
    assert len(pairs) > 1000
    assert sum(a == b for a, b in pairs) < 0.02 * len(pairs)


@pytest.mark.parametrize("window", [2, minhash.WINDOW])
def test_links_inside_a_family_on_one_template(spark, window):
    """Texts on one template are nearly linked with all others; pairs inside the family must be found all the same."""
    rng = random.Random(31)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    template = fresh(180)
    made = []
    for i in range(300):
        own = fresh(17)
        made.append((i, " ".join(template + own)))
        if i < 60:  # a partner, which shares all but a few own words
            made.append((1000 + i, " ".join(template + own[:12] + fresh(3 + i % 6))))
    near = fresh(120)  # near copies that are all linked, some over one middle text only
    made += [(2000 + i, " ".join(near + fresh(1 + i % 8))) for i in range(150)]
    rng.shuffle(made)
    sets = {i: shingles(t) for i, t in made}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = 0
    for x, y in itertools.combinations(sorted(sets), 2):
        shared = len(sets[x] & sets[y])
        if 100 * shared >= 85 * (len(sets[x]) + len(sets[y]) - shared):
            pairs += 1
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
    assert pairs > 5000 and len({find(i) for i in sets}) > 200
    frame = spark.createDataFrame(made, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame, window=window).collect()}
    assert found == {i: find(i) for i in sets}


def test_shingles_that_linked_sets_share():
    """Of two linked sets the smaller one's indexed shingles meet the larger one's leading ones, whatever the sizes."""
    for percent in (80, 85, 90):
        for a in range(1, 120):
            for b in range(a, 100 * a // percent + 1):
                shared = -(-percent * (a + b) // (100 + percent))  # the fewest that link them
                if shared <= a:
                    assert a - shared + 1 <= minhash.index_length(a, percent) and b - shared + 1 <= minhash.probe_length(b, percent)


def test_near_copies_of_the_pipeline(spark):
    """Similarity 0.80 to 0.85 counts in the pipeline, not in op1."""
    rng = random.Random(21)
    made = []
    for i in range(150):
        w = [f"u{rng.randrange(10**9)}" for _ in range(104)]
        made += [(2 * i, " ".join(w), "s", "x", 1), (2 * i + 1, " ".join([*w[:95], *(f"v{rng.randrange(10**9)}" for _ in range(9))]), "s", "x", 1)]
    a, b = shingles(made[0][1]), shingles(made[1][1])
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    frame = spark.createDataFrame(made, DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()} == set(range(0, 300, 2))
    assert keep_first(frame).count() == 300
    for percent in (80, 85, 90):
        share = percent / 100
        assert (1 - share ** minhash.least_depth(percent)) ** minhash.ORDERS <= minhash.MISSED
    assert (minhash.least_depth(85), round(minhash.least_agreement(85), 2)) == (3, 0.69)


def test_quality_counts_all_trusted_texts(spark):
    """The trusted texts are all rows of label 1, past the number that once was the bound; other rows that share a bit stay out."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"))
    trusted = spark.range(25_000).select(F.col("id").alias("doc_id"))
    assert quality._counts(quality._trusted_texts(docs, trusted), 16, 4).sum() == 25_000


def test_quality(spark, docs, rows, empty):
    rng = random.Random(6)
    good = [(1000 + i, words(rng, 120), "s", "x", 1) for i in range(60)]
    junk = [(2000 + i, words(rng, 120).upper().replace(" ", "!! "), "s", "x", 1) for i in range(20)]
    frame = docs.union(spark.createDataFrame(good + junk, DOCS))
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, *_ in good + junk if i % 2] + [(None, 1), (1001, 0)], "doc_id long, quality int")
    found = judge_quality(frame, labels).collect()
    texts = collections.defaultdict(list)
    for i, t, *_ in [*rows, *good, *junk]:
        texts[i].append(t or "")
    assert len(found) == sum(map(len, texts.values()))
    for r in found:
        t = texts[r["doc_id"]][0]
        w = WORD.findall(t)
        often = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        if 1000 <= (r["doc_id"] or 0) < 3000:
            assert r["kept"] == (r["doc_id"] < 2000)
    assert judge_quality(empty, labels).count() == 0 and judge_quality(docs, labels.limit(0)).count() == len(rows)


def suppressed(norm, rules):
    """Every rule on every text, without gates; containment judged over all pairs."""
    found = []
    for number, (label, regex, _, priority, confidence) in enumerate(rules):
        for m in re.finditer(f" ((?:{regex}))(?= )", norm):
            start = norm[: m.start()].count(" ")
            found.append((start, start + m.group(1).count(" ") + 1, priority, number, label, confidence))
    def beats(e, d):
        inside = e[0] <= d[0] and e[1] >= d[1] and e[3] != d[3]
        longer, same = e[1] - e[0] > d[1] - d[0], e[:2] == d[:2]
        return inside and (e[2] < d[2] or e[2] == d[2] and (longer or same and e[3] < d[3]))
    return sorted(d for d in found if not any(beats(e, d) for e in found))


def test_licenses(spark, empty):
    rules = license_rules.rules()
    assert len(rules) > 300
    rng = random.Random(9)
    lines = [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.", "CC-BY 4.0", "cc by",
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: BSD-3-Clause", "GPLv2", "MPL 2.0",
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "Copyright (c) 2020", "cc0",
        "Creative Commons Attribution-ShareAlike 4.0 International", "permission is hereby granted, free of charge, to any person obtaining a copy",
    ]
    texts = [None, "", "?!", "no rules here", "all rights reserved " * 2000, "É cc Éby cc  by", "licensed under the \u212aelvin license; wtfpl or \u212a; do what the fuc\u212a you want to public license"]
    texts += [" ".join(rng.choice([*lines, "the mit", "word", "\n"]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, "s", "x", 1) for i, t in enumerate(texts)], DOCS)
    for r in scan_licenses(frame).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r["doc_id"]] or ""))
        places = [(i, label) for p, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
                  for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert r["n_words"] == len(w) and sorted(map(tuple, r["places"])) == sorted(places)
        assert list(r["base_labels"]) == sorted({x for _, x in places})
        if len(w) < 1000:
            expected = suppressed(f" {' '.join(w)} ", rules)
            assert [tuple(d) for d in r["detections"]] == expected
            assert list(r["labels"]) == sorted({x for _, x in places} | {d[4] for d in expected})
        assert 0 <= r["score"] <= 1
    assert scan_licenses(empty).count() == 0


def sample_match(parsed, rng):
    """A random text that a parsed regex matches."""
    out = ""
    for kind, arg in parsed:
        name = str(kind)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, arg = rng.choice(arg)
            out += chr(rng.randint(*arg)) if str(kind) == "RANGE" else chr(arg) if str(kind) == "LITERAL" else "x"
        elif name == "BRANCH":
            out += sample_match(rng.choice(arg[1]), rng)
        elif name == "MAX_REPEAT":
            out += "".join(sample_match(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert name == "SUBPATTERN", name
            out += sample_match(arg[3], rng)
    return out


def test_gates_pass_every_match(spark):
    """Whatever a rule matches holds a stem and the rule's own gate."""
    rng = random.Random(10)
    stem = re.compile(" (?:" + "|".join(license_rules.STEMS) + ")")
    for label, regex, gates, *_ in license_rules.rules():
        for _ in range(120):
            text = f" {sample_match(re._parser.parse(regex), rng)} "
            assert re.fullmatch(f" (?:{regex}) ", text)
            assert stem.search(text) and any(f" {g}" in text for g in gates.split("|")), (label, text)
    lines = [
        "Released under MIT", "Distributed under MIT", "published under the terms of MIT", "governed by MIT", "see MIT", "MIT-0", "MIT No Attribution",
        "ein Haus mit Garten",
    ]
    frame = spark.createDataFrame([(i, t, "s", "x", 1) for i, t in enumerate(lines)], DOCS)
    found = {r["doc_id"]: list(r["labels"]) for r in scan_licenses(frame).collect()}
    assert found == {**{i: ["mit"] for i in range(5)}, 5: ["mit-0"], 6: ["mit-0"], 7: []}


def brute_cut(rows, length):
    lowest = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            if i is not None:
                s = raw[k : k + length]
                lowest[s] = min(lowest.get(s, i), i)
    out = collections.defaultdict(list)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if i is not None and lowest[raw[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        out[i].append((len(raw), len(raw) - len(kept), runs, kept))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_passages(docs, rows, empty, hot):
    expected = brute_cut(rows, 50)
    found = cut_repeats(docs, hot=hot).collect()
    assert len(found) == len(rows)
    for r in found:
        n, removed, runs, kept = expected[r["doc_id"]][0]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (n, removed, runs, kept)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert sum(r["n_removed"] for r in found) > 5000
    assert cut_repeats(empty).count() == 0
    texts = cut_texts(docs, hot=hot)
    assert texts.columns == docs.columns
    nulls = {i for i, t, *_ in rows if t is None}
    for r in texts.collect():
        assert r["text"] == (None if r["doc_id"] in nulls else expected[r["doc_id"]][0][3].decode(errors="ignore"))


def test_merge_of_transforms():
    rng = random.Random(1)
    for _ in range(150):
        base = "".join(rng.choice("abé") for _ in range(60)).encode()
        length = rng.choice([3, 5, 8])
        pieces = []
        for _ in range(rng.randint(1, 12)):
            a = rng.randint(0, len(base) - length)
            pieces.append(base[a : rng.randint(a + length, len(base))] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 6))))
        doc = np.array([rng.randint(0, 9) for _ in pieces])
        offs = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        low = {}
        for p, d in zip(pieces, doc, strict=True):
            for k in range(len(p) - length + 1):
                low[p[k : k + length]] = min(low.get(p[k : k + length], 99), d)
        found = [set() for _ in pieces]
        for i, at, size in zip(*covered_spans(np.zeros(len(pieces), np.int64), data, offs, doc, length), strict=True):
            found[i] |= set(range(at, at + size))
        for i, (p, d) in enumerate(zip(pieces, doc, strict=True)):
            starts = [k for k in range(len(p) - length + 1) if low[p[k : k + length]] < d]
            assert found[i] == {x for k in starts for x in range(k, k + length)}


def test_equal_strings_have_equal_anchors():
    rng = random.Random(7)
    text = "".join(rng.choice("abc é") for _ in range(400)).encode()
    data = np.frombuffer(text[:300] + text[100:], dtype=np.uint8)
    names, row, first, last = passages.anchor_runs(data, np.array([0, 300, len(data)]))
    by_string = collections.defaultdict(set)
    for name, lo, hi in zip(names, first, last, strict=True):
        for k in range(lo, hi + 1):
            by_string[data[k : k + 50].tobytes()].add(name)
    assert len(by_string) > 250 and all(len(v) == 1 for v in by_string.values())
    assert sum(last - first + 1) == 300 - 49 + len(data) - 300 - 49


def test_tokens_equal_the_tokenizer(rows):
    encoder = Tokenizer.from_file(default_vocabulary())
    texts = [t for _, t, *_ in rows] + ["<|endoftext|> a<|endoftext|>b", "  a", "\n x  y \n", "é  é", "a 　b", "it's 'll  'x", "\x1f x", " "]
    ids, bounds = encode_column(pa.array(texts), default_vocabulary())
    for i, t in enumerate(texts):
        assert list(ids[bounds[i] : bounds[i + 1]]) == encoder.encode(t or "", add_special_tokens=False).ids


def test_packing(docs, rows, empty):
    encoder = Tokenizer.from_file(default_vocabulary())
    found = pack(docs, window=256, keep_ids=True).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    short = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in parts] == [sum(x["length"] for x in parts[:i]) for i in range(len(parts))]
        total = sum(p["length"] for p in parts)
        short += total < 256
        assert total <= 256 and parts[0]["padded_length"] == (total if total & (total - 1) == 0 else 256)
    assert short <= docs.rdd.getNumPartitions()
    for i, t, *_ in {r[:2]: r for r in rows}.values():
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i, len(ids)], key=lambda r: r["start"])
        copies = max(1, sum(r["length"] for r in own) // len(ids))
        assert sum(r["length"] for r in own) == copies * len(ids)
        if copies == 1:
            assert np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist() == ids
    assert pack(empty).count() == 0


def test_packer_picks_the_least_sum_of_squares():
    rng = random.Random(3)
    packer = Packer(window=64, max_open=10_000)
    for k in range(400):
        size = rng.randint(1, 63)
        counts = packer.count.copy()

        def cost(level, size=size, counts=counts):
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 64
            return int((after[1:64] ** 2).sum())

        options = [h for h in range(0, 65 - size) if h == 0 or counts[h]]
        level = packer._level(size)
        assert cost(level) == min(map(cost, options))
        list(packer.add(k, np.zeros(size, dtype=np.uint32)))
