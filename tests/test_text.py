import pytest
from pyspark.sql import functions as F

from markwell.functions import registry
from markwell.functions import text as T
from markwell.operators import layout


def test_normalize(one):
    assert one(T.normalize_ws_lower, "  Ёж\u00a0И \n КОТ ") == "ёж и кот"
    assert one(T.normalize_ws_lower, None) == ""
    assert one(T.normalize_strip_punct, "Это — Тест, да_да!") == "это тест да_да"


def test_page_furniture(one):
    text = "Страница 3\n  12 \nstart" + " " * 16 + "7\n\nsee page 4 now\nlong enough line" + " " * 20 + "9"
    # the far-right number is cut only behind at most ten characters
    assert one(T.strip_page_furniture, text).split("\n") == ["start", "see  now", "long enough line" + " " * 20 + "9"]


def test_sentences_and_paragraphs(one):
    assert one(T.split_sentences, "a. b!  c? ") == ["a", "b", "c"]
    assert one(T.split_paragraphs, "x" * 19 + "\n \n" + "y" * 20) == ["y" * 20]


def test_tokenize(one):
    assert one(T.tokenize, "это более длинный текст the on word") == ["это", "длинный", "текст", "word"]


def test_file_names(one):
    assert one(T.file_extension, "a.b.TXT") == "txt"
    assert one(T.file_extension, "noext") == ""
    assert one(T.file_stem, "a.b.txt") == "a.b"


def test_sanitize(one):
    assert one(T.sanitize_for_prompt, " ").startswith("Отчёт пустой")
    assert one(T.sanitize_for_prompt, "a\r\n\n\n\n\nb \t c") == "a\n\n\nb c"
    long = one(T.sanitize_for_prompt, "x" * 12001)
    assert len(long) > 12000 and long.endswith("(отчёт обрезан по длине)")


@pytest.mark.parametrize(
    "text, expected",
    [("", True), ("short", False), ("a" * 250, False), ("b" * 210 + "#" * 40, True), ("12 34 " * 300, True)],
)
def test_gibberish(one, text, expected):
    assert one(T.gibberish, text) is expected


def test_extract_score(one):
    assert one(T.extract_score, "балл 150, потом 87.5 из 100") == 87.5
    assert one(T.extract_score, "a1b нет") is None
    assert one(T.extract_score, "12.5a") == 12.0


def test_embedded_json(one):
    assert one(lambda c: T.extract_embedded_json(c, "struct<k:int>"), 'x {"k": 5} y')["k"] == 5
    assert one(lambda c: T.extract_embedded_json(c, "struct<k:int>"), "x {broken} y") is None


def test_ordinals(one):
    assert [one(T.ordinal_number, w) for w in ("Первое", "четвёртый", "десятая", "сто")] == [1, 4, 10, 0]
    assert [one(T.roman_number, w) for w in ("iv", " II ", "X")] == [4, 2, 0]


def test_match_starts(spark):
    df = spark.createDataFrame([("a1bb22c",), ("",), ("333",)], "t string")
    got = [[(m["pos"], m["hit"]) for m in r["x"]] for r in df.select(F.expr(T.match_starts("t", r"\d+")).alias("x")).collect()]
    assert got == [[(1, "1"), (4, "22")], [], [(0, "333")]]


def test_run_lengths(spark):
    df = spark.createDataFrame([([1, 1, 2, 5, 5, 5],), ([],)], "t array<int>")
    rows = df.select(T.run_lengths(F.col("t")).alias("x")).collect()
    assert [tuple(r) for r in rows[0]["x"]] == [(1, 2), (2, 1), (5, 3)]
    assert rows[1]["x"] is None


def test_decode_text(spark):
    rows = [(1, "привет é".encode()), (2, "привет".encode("cp1251"))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "i int, b binary")
    got = {r["i"]: r["x"] for r in df.select("i", registry.decode_text(F.col("b")).alias("x")).collect()}
    assert got == {1: "привет é", 2: "привет"}


def test_registry_unknown_name():
    with pytest.raises(ValueError, match="unknown embedder"):
        registry.embedder("nope")
    registry.EMBEDDERS.register("Custom", lambda c: F.array(F.lit(1.0)))
    assert "custom" in registry.EMBEDDERS.names()


def test_pipe_tables(spark):
    text = "intro\n| Name | b |\n|---|---|\n| 1 | | 2 |\nbreak\n---|---\nx|y"
    df = spark.createDataFrame([(1, text), (2, "no table")], "id int, text string")
    rows = layout.pipe_table_rows(df, "id", "text").orderBy("table_no", "row_no").collect()
    assert [(r.table_no, r.row_no, r.is_header, r.cells) for r in rows] == [
        (1, 1, True, ["Name", "b"]), (1, 2, False, ["1", "", "2"]), (2, 1, False, ["x", "y"]),
    ]


def test_interleave_images(spark):
    texts = spark.createDataFrame(
        [(1, "a [Изображение: x] b [Изображение] c"), (2, " plain "), (3, "[Изображение]")], "doc_id int, content string"
    )
    images = spark.createDataFrame(
        [(1, 9, "p9", ""), (1, 5, "p5", ""), (1, 30, "p30", ""), (1, 40, "p40", ""), (2, 1, "q", "")],
        "doc_id int, position int, image_path string, ocr_text string",
    )
    rows = layout.interleave_images(texts, images).orderBy("doc_id", "seq").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.content or r.image_path)
    assert got == {1: ["a", "p5", "b", "p9", "c", "p30", "p40"], 2: [" plain ", "q"]}


def test_list_numbering(spark):
    items = [(0, 0, ""), (1, 1, ""), (2, 1, ""), (3, 0, ""), (4, 1, ""), (5, 1, "1. typed"), (6, 1, ""), (7, 0, "")]
    df = spark.createDataFrame([(1, p, "L", lv, t or "x") for p, lv, t in items], "doc_id int, pos int, list_id string, level int, text string")
    got = {r.pos: r.prefix for r in layout.list_numbering(df).collect()}
    assert got == {0: "1. ", 1: "  1. ", 2: "  2. ", 3: "2. ", 4: "  1. ", 5: "", 6: "  2. ", 7: "3. "}


def styled_rows(spark, tmp_path, texts, name):
    """Rows of a query and of its SQL over ``documents`` of the given (doc_id, text)."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    path = f"{tmp_path}/documents.parquet"
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.selectExpr("*", "'en' AS lang", "'web' AS source", "cast(length(text) AS long) AS n_chars").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    return sorted(tuple(r) for r in got), sorted(want.fetchall())


def test_clean_lines_of_blank_texts_equal_sql(spark, tmp_path):
    # the ids 11, 71, 131 and 191 add no lines of their own
    texts = [(11, " \n\t\n"), (71, None), (18, None), (131, ""), (13, " a \n\n b"), (191, "\n x \n")]
    got, want = styled_rows(spark, tmp_path, texts, "clean_lines")
    assert got == want and [r[0] for r in got] == [13, 18, 191]


def test_metrics_summary_equals_sql(spark, tmp_path):
    """A readability that rounds to a negative zero, a missing text, and vowels behind a dotted capital."""
    near_zero = " ".join(["babab"] * 42 + ["bab"] * 7) + "."  # readability -0.014
    texts = [(11, "x" * 12), (18, None), (71, "İaİe İİ bİo word word."), (131, near_zero), (191, "İstanbul İ")]
    got, want = styled_rows(spark, tmp_path, texts, "metrics_summary")
    assert got == want and any("Читаемость: -0.0" in r[2] for r in got)
