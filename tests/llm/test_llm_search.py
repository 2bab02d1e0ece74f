"""Lexical search, SentencePiece ids and whitening against brute-force versions."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from markwell.llm import lexical, pieces, whitening
from markwell.llm.lexical import rank_documents
from markwell.llm.minhash import keep_first
from markwell.llm.mixing import mix_sources, shuffled_mix, shuffled_shards
from markwell.llm.pieces import decode_pieces, default_model, encode_pieces
from markwell.llm.whitening import whiten

DOCS = "doc_id long, text string, ids string, item long, size int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute_ranking(docs, items, top):
    """Per item, in order, its best (doc_id, score)."""
    held = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        wanted = collections.Counter(terms_of(text))
        scored = []
        for i, c in held:
            m = 25 + 75 * c.total() * n // total
            score = 0
            for t, k in wanted.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += k * w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if absent else i, -s) for r, (s, absent, i) in enumerate(sorted(scored)[:top])]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = [" ".join(rng.choice("alpha Beta gamma δelta x1 été the of".split()) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    made[0] += " zeta"
    return made + [made[0]] * 30 + [None, "", " \n", "...", "THE the The", "日本 語 the", "a" * 3000, "beta-" * 4000, "naïve\x00null"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[2], (None, texts[5], "clash", 1, 2)], DOCS).repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "Beta the beta δelta"), (2, None), (3, "nothing here"), (4, "THE"), (4, "alpha x1 été été"), (None, "of gamma"), (6, ""), (7, "zeta")]
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "item_id long, text string, doc_id string, score int")


@pytest.mark.parametrize("tile, group", [(4096, 512), (2, 2)])
def test_ranking(docs, items, monkeypatch, tile, group):
    monkeypatch.setattr(lexical, "TILE_TERMS", tile)
    monkeypatch.setattr(lexical, "TILE_DOCS", 7 if tile == 2 else 256)
    monkeypatch.setattr(lexical, "GROUP_ITEMS", group)
    found = sorted((tuple(r) for r in rank_documents(docs, items).collect()), key=str)
    want = brute_ranking([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 10)
    assert found == sorted(want, key=str)
    ties = [r for r in want if r[0] == 7]
    assert len(ties) == 10 and len({s for *_, s in ties}) == 1


def test_ranking_of_empty_tables(docs, items):
    assert rank_documents(docs.limit(0), items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0
    assert rank_documents(docs.filter("doc_id IN (90, 91)"), items).count() == 0


def test_products_stay_exact():
    """Sums near 2^53 are cut into tiles; a term repeated beyond what one product can hold is added as integers."""
    repeats = {b"a": 90_000, b"b": 95_000, b"c": 80_000, b"d": 500_000}
    group = lexical.Items.of([(1, repeats), (2, {b"a": 1})])
    corpus = lexical.Corpus(10**12, 10**14, np.ones(4, dtype=np.int64))
    tiles = lexical.vocabulary_tiles(group, corpus.weights())
    assert len(tiles) > 1 and tiles[0][0] == 0 and tiles[-1][1] == 4
    counts = np.array([3, 10**6 + 7, 5, 10**7 + 1])
    got = lexical.Scorer(group, corpus).scores(np.array([100]), np.array([4]), np.arange(4), counts)
    m, w = 25 + 75 * 100 * 10**12 // 10**14, corpus.weights().tolist()
    impacts = [10**9 * int(c) // (1000 * int(c) + 8 * m) for c in counts]
    assert got[:, 0].tolist() == [sum(k * a * b for k, a, b in zip(repeats.values(), w, impacts, strict=True)), w[0] * impacts[0]]
    huge = np.array([10**7, 10**8])
    assert corpus.damping(huge).tolist() == [25 + 75 * int(x) * 10**12 // 10**14 for x in huge]


# ---------------------------------------------------------------- names of columns in stages


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as those that operators use inside or add come through near-dedup and the mix unchanged."""
    names = ["_kept", "row", "key", "part", "_part", "mix_pass", "mix_shard", "mix_order", "draw", "size"]
    rows = [(i, f"text number {i} of this table", f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    whole = {tuple(r) for r in docs.collect()}
    kept = keep_first(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == whole
    mixed = shuffled_mix(docs)
    found = [tuple(r) for r in mixed.collect()]
    assert mixed.columns == docs.columns and set(found) <= whole and len(found) > len(set(found)) > 0
    report = mix_sources(docs)
    assert report.columns.count("mix_order") == 1 and report.count() == len(found)
    assert sorted(r["doc_id"] for r in shuffled_shards(report).collect()) == sorted(f[0] for f in found)


# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def odd_texts():
    rng = random.Random(11)
    parts = [" ", "  ", "▁", "▁▁", "a", "the", "Größe", "\n", "\t", "é", "日", "𝒳", "\x00", "<s>", "</s>", "<unk>", "　", "�", "x" * 90, "the " * 20]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]
    return made + [None, "", " ", " " * 5000, "▁", "word " * 20000, "x" * 20000]


def test_encoding_and_decoding(spark, library):
    texts = odd_texts()
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 1, 2), (None, "null key", "clash", 1, 2)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = decode_pieces(encode_pieces(docs)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = "null key" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        want = library.encode(text, add_eos=True)
        assert r["ids"] == want and r["decoded"] == library.decode(want), text[:80]
    both = encode_pieces(docs, bos=True).filter("doc_id = 3").first()["ids"]
    assert both == library.encode(texts[3], add_bos=True, add_eos=True)
    assert encode_pieces(docs, eos=False).filter("doc_id = 401").first()["ids"] == []
    assert decode_pieces(encode_pieces(docs.limit(0))).count() == 0


def test_small_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 8)
    table = pieces.WordTable(default_model())
    for text in [t for t in odd_texts() if t][:150]:
        flat, bounds = table.encode(pa.array([text, None, text]))
        one = library.encode(text)
        assert flat.tolist() == one * 2 and bounds.tolist() == [0, len(one), len(one), 2 * len(one)]
        assert len(table.count) == len(table.place)


def test_other_models_take_whole_texts(library, monkeypatch):
    monkeypatch.setattr(pieces, "splits_at_markers", lambda model: False)
    table = pieces.WordTable(default_model())
    for text in ["a b  c", " x", "word"]:
        assert table.encode(pa.array([text]))[0].tolist() == library.encode(text)


def test_decoding_any_ids(spark, library):
    rng = random.Random(2)
    draw = [lambda: 0, lambda: 1, lambda: 2, lambda: rng.randrange(3, 260), lambda: rng.randrange(260, 32000), lambda: 28705]
    lists = [[rng.choice(draw)() for _ in range(rng.randrange(10))] for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(lists)), "row long, ids array<int>").repartition(2)
    got = {r["row"]: r["decoded"] for r in decode_pieces(df).collect()}
    assert [got[i] for i in range(len(lists))] == library.decode(lists)
    odd = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [None], "z")], "doc_id long, ids array<int>, decoded string")
    assert {r["doc_id"]: r["decoded"] for r in decode_pieces(odd).collect()} == {1: "", 2: "", 3: " ⁇ "}


# ---------------------------------------------------------------- whitening


def vector_table(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "clash", 0.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, whitened double").repartition(3)


def check_whitening(found, usable, components):
    x = np.floor(64 * np.array([usable[i] for i in sorted(usable)])).astype(np.int64)
    n, centred = len(x), x - x.mean(axis=0)
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-13 * e.sum()).sum()))
    rows = sorted(found, key=lambda r: r["vec_id"])
    assert [r["vec_id"] for r in rows] == sorted(usable)
    exact = x.astype(object)
    exact = ((n * exact - exact.sum(axis=0)) ** 2).sum(axis=1)
    assert [int(r["deviation"]) for r in rows] == exact.tolist()
    assert {r["n"] for r in rows} == {n} and max(r["identity_error"] for r in rows) < 1e-9
    got = np.array([r["whitened"] for r in rows])
    assert got.shape == (n, k)
    np.testing.assert_allclose([r["explained"] for r in rows], np.tile(e[:k] / e.sum(), (n, 1)), rtol=1e-10)
    gaps = np.abs(e[:k, None] - e[None, :]) + np.diag(np.full(len(e), np.inf))[:k]
    for c in np.flatnonzero(gaps.min(axis=1) > 1e-6 * e[0]):
        want = centred @ q[:, c] / np.sqrt(e[c])
        np.testing.assert_allclose(got[:, c] * np.sign(got[:, c] @ want), want, atol=1e-7)


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(4)
    made = [list(v) for v in rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + 5]
    made += [made[0]] * 120  # repeated rows count each time
    odd = [None, [], [1.0] * 5, [None, *made[1][1:]], [float("nan"), *made[2][1:]], [*made[3][:-1], float("inf")]]
    usable = dict(enumerate(made))
    check_whitening(whiten(vector_table(spark, made + odd), components=5).collect(), usable, 5)
    check_whitening(whiten(vector_table(spark, made + odd)).collect(), usable, 32)


def test_whitening_of_flat_and_repeated_directions(spark):
    cross = [[s * (a == b) for b in range(6)] for a in range(4) for s in (1.0, -1.0)]  # four equal eigenvalues, two flat directions
    check_whitening(whiten(vector_table(spark, cross)).collect(), dict(enumerate(cross)), 32)
    same = whiten(vector_table(spark, [[1.0, 2.0]] * 4)).collect()
    assert len(same) == 4 and all(r["whitened"] == [] and r["deviation"] == 0 for r in same)
    assert whiten(vector_table(spark, [None, [float("nan")]])).count() == 0
    assert whiten(vector_table(spark, [])).count() == 0


def test_whitening_of_extreme_entries(spark):
    wide = [[1e12, 1.0], [-1e12, 2.0], [3.0, 3.0]]
    check_exact = {r["vec_id"]: int(r["deviation"]) for r in whiten(vector_table(spark, wide)).collect()}
    x = np.floor(64 * np.array(wide)).astype(np.int64).astype(object)
    assert check_exact == dict(enumerate(((3 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()))
    assert whiten(vector_table(spark, [[1e300, 1.0], [0.0, 2.0]])).count() == 2


def test_audit_blocks_without_linked_pairs(spark, monkeypatch):
    """Blocks of the audit, and whole tasks, in which no vector is linked; the few linked ones are found all the same."""
    from markwell.llm import vector_graph

    monkeypatch.setattr(vector_graph, "AUDIT_BLOCK", 4)
    monkeypatch.setattr(vector_graph, "AUDIT_QUERIES", 8)
    monkeypatch.setattr(vector_graph, "LOOK_CELLS", 50, raising=False)
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(200, 32))
    rows[150:160] = rows[7] + 0.01 * rng.normal(size=(10, 32))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>").repartition(5)
    found = {r.vec_id: r.n_links for r in vector_graph.link_vectors(frame, shard_rows=20).collect()}
    family = {7, *range(150, 160)}
    assert found == {i: 10 if i in family else 0 for i in range(200)}


def test_anchors_shared_by_chance_do_not_travel(spark):
    """Documents that share an anchor's bytes but no string of 50 bytes stay where they are; those that share one, at any place of it, don't."""
    from markwell.llm import passages

    rng = random.Random(4)

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    short, long = noise(24), noise(50)
    texts = [noise(200) + short + noise(200) for _ in range(30)]
    texts += [noise(100) + long + noise(100), long + noise(90), noise(80) + long, noise(60) + long[:49] + "#" + noise(60), long]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    named = passages._shared_anchors(passages._anchors(frame, 50, 4), 2, 100).select("doc_id").distinct().collect()
    # the text with one byte less of the passage still has a side of an anchor in common with it
    assert {30, 31, 32, 34} <= {r.doc_id for r in named} <= {30, 31, 32, 33, 34}
    found = {r.doc_id: r.n_removed for r in passages.cut_repeats(frame).collect()}
    assert found == {i: 50 if i in (31, 32, 34) else 0 for i in range(35)}


@pytest.mark.parametrize("columns", [["doc_id", "text"], ["doc_id", "text", "lang"]])
def test_texts_are_exchanged_once(spark, columns):
    """Both joins of the passages read one exchange of the texts, so shuffle files hold them once."""
    from markwell.llm import passages

    text = "some words that stand in both of the documents, long enough for a passage of fifty bytes"
    frame = spark.createDataFrame([(1, "a " + text, "en"), (2, text + " b", "en"), (3, "a " + text, "de")], "doc_id long, text string, lang string")
    out = passages.cut_texts(frame.select(*columns))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()

    def exchanges(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return exchanges(node.inputPlan())
        children = node.children()
        mine = [node] if "REPARTITION_BY_COL" in node.simpleString(99) and "doc_id" in node.simpleString(99) else []
        return mine + [x for i in range(children.size()) for x in exchanges(children.apply(i))]

    one, two = exchanges(plan)
    assert one.canonicalized().equals(two.canonicalized())
