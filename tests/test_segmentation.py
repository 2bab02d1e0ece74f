import random

import duckdb
import pytest
from pyspark.sql import functions as F

from markwell.catalogues import INTERVIEW
from markwell.functions.sqlfuncs import register_functions
from markwell.operators import answers as A
from markwell.operators import cleaning as C
from markwell.operators import criteria as R
from markwell.operators import segmentation as G
from markwell.plans import load_catalog


def segment(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, content string")
    return [r.content for r in G.segment_submissions(df, **options).orderBy("task_number").collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Задание 1. альфа\nЗадание №2 бета\nПервый\nтретье задание: гамма\nОтвет на 4 дельта", ["альфа", "бета\nПервый", "гамма", "дельта"]),
        ("А) раз\nБ) два\nС) три\nД) четыре", ["раз", "два", "три", "четыре"]),
        ("I) one\nII) two\nIII) three\nIV) four", ["one", "two", "three", "four"]),
        ("1. a\n2. b\n3. c\n4. d", ["a", "b", "c", "d"]),
        ("ВОПРОС 2\nвторой\nвопрос 1:\nпервый", ["первый", "второй", "", ""]),
        ("1 : раз\n2: два", ["раз", "два", "", ""]),
        ("Вопрос первый: раз\nВопрос вторая два", ["раз", "два", "", ""]),
        ("нет меток", ["", "", "", ""]),
        ("", ["", "", "", ""]),
    ],
)
def test_marker_styles(spark, text, expected):
    assert segment(spark, text) == expected


def test_sub_items_stay_inside_an_answer(spark):
    text = "Вопрос 1. список\n1. пункт\nВопрос 2. б\nВопрос 3. в\n4. четвертый"
    assert segment(spark, text) == ["список\n1. пункт", "б", "в", "четвертый"]


def test_marker_form_inside_an_answer_takes_no_text(spark):
    text = "Первое задание: With a haor, in blend.\nA. Ble sttion.\nВторое задание: б"
    expected = ["With a haor, in blend.\nA. Ble sttion.", "б", "", ""]
    assert segment(spark, text) == expected
    register_functions(spark)
    rows = spark.sql("SELECT * FROM segment_text(:t)", args={"t": text}).collect()
    assert [r.content for r in sorted(rows, key=lambda r: r.task_number)] == expected
    # two forms that stand together are one marker
    assert segment(spark, "1. Вопрос 1. раз\nЗадание №2\nВопрос 2. два") == ["раз", "два", "", ""]


def test_explicit_markers_query_with_a_lettered_line(spark, tmp_path):
    """A line "A. ..." inside an answer, in a document of every style: the rows are those of the SQL."""
    turns = [(c, t, "user", f"text {c} {t}\nA. Orsh {t}" if t % 4 == 1 else f"text {t}") for c in range(6) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").toPandas().to_parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    entry = load_catalog()["explicit_markers"]
    got = entry.build(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle})").fetchall()
    assert len(want) == 20 and sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_image_before_next_marker_ends_the_answer(spark):
    text = "Вопрос 1. текст [Изображение: a] Задание 1\nВопрос 2. б"
    assert segment(spark, text)[0] == "текст"


def test_anchor_fallback(spark):
    text = "clients (id) плоха\nтаблица items хороша\nselect department_id from x\nв комнате карандаш у стены"
    assert segment(spark, text) == ["clients (id) плоха", "таблица items хороша", "select department_id from x\nв комнате", "карандаш у стены"]


def test_prompt_removal_respects_schemas(spark):
    df = spark.createDataFrame(
        [(1, "Таблица имеет следующую схему: clients (id int)\nЗадание 2. ответ"), (4, G.PROMPT_QUESTION.lower() + " ответ"), (3, "Задание 1 x")],
        "n int, t string",
    )
    rows = df.select("n", G.strip_prompt_text(F.col("t"), F.col("n"), (1, 4)).alias("x")).collect()
    assert {r.n: r.x for r in rows} == {1: "clients (id int)\nответ", 4: "ответ", 3: "Задание 1 x"}


def test_problems(spark):
    df = spark.createDataFrame([(1, "Вопрос 1 а\nВопрос 2 б"), (2, "Вопрос 1 а\nВопрос 2 б\nВопрос 3 в\nВопрос 4 г")], "doc_id long, content string")
    rows = G.extraction_problems(G.segment_documents(df)).collect()
    assert [(r.doc_id, r.tasks_found, r.empty_tasks, r.detected_markers) for r in rows] == [
        (1, 2, [3, 4], ["Вопрос 1 а", "Вопрос 2 б"])
    ]


def test_images_on_boundaries(spark):
    markers = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "doc_id int, task_number int, start int")
    images = spark.createDataFrame([(1, p) for p in (5, 10, 15, 20, 21)] + [(2, 1)], "doc_id int, position int")
    got = {(r.doc_id, r.position): r.task_number for r in G.assign_images(images, markers).collect()}
    assert got == {(1, 5): None, (1, 10): 1, (1, 15): 1, (1, 20): 1, (1, 21): 2, (2, 1): None}


def answers(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, 1)], "doc_id long, task_number int, content string")


def test_tails_move(spark):
    first = "красная рыба плывет по морю. собака лает на улице громко"
    df = answers(spark, first, "собака лает на улице громко", "совсем другое содержание ответа", "")
    out = C.clean_tasks(df, threshold=0.9).first()
    assert out.task_1 == "красная рыба плывет по морю."
    assert out.task_2_tails == ["собака лает на улице громко"]
    # the second answer is itself a fragment of the first, so it moves as well
    assert out.tails_detected >= 1
    assert len(out.task_1) <= len(first)
    two_steps = C.redistribute_tails(df, C.detect_tails(df, threshold=0.9)).first()
    assert two_steps.task_1 == out.task_1 and two_steps.tails_detected == out.tails_detected


def test_slots_and_status(spark):
    df = answers(spark, "a", " ", "c")
    assert [r.content for r in A.normalize_slots(df).orderBy("task_number").collect()] == ["a", "", "c", ""]
    row = A.pivot_tasks(df).first()
    assert (row.tasks_count, row.cleaning_status) == (2, "validated")


def test_interview_criteria(spark):
    df = answers(spark, "нужен primary key и статус", "x", "rejoin", "физически невозможно, потому что стена")
    got = {(r.task_number, r.name): (r.passed, r.matched_keywords) for r in R.criteria_match(df, INTERVIEW).collect()}
    assert got[(1, "Первичный/внешний ключи")] == (True, ["primary key"])
    assert got[(1, "Дополнительные поля")] == (True, ["статус"])
    assert got[(3, "Явный JOIN")][0] is False  # whole words only
    assert got[(4, "Отсутствие ошибок")] == (False, ["физически невозможно"])
    assert got[(4, "Скрытое условие")][0] is True
    assert len(got) == 24


def test_table_function_equals_the_operator(spark):
    """Texts that mix explicit markers, bare numbers, lists, images, anchors, page lines and copied prompts in random order."""
    rng = random.Random(9)
    parts = [
        "Вопрос 1. ", "Задание №2 ", "вопрос 3: ", "Ответ на 4 ", "\n1. ", "\n2) ", "\n3. ", "\n4. ", "Первое задание: ", "II) ", "\nА) ", "слово ", "\n",
        "таблица clients ", "Таблица items ", "select department_id ", "карандаш у стены ", "[Изображение: x] ", "Страница 3\n", "\n12\n", ";\n \n",
        "текст ответа длиннее двадцати знаков. ", "Почему карандаш в комнате нельзя перепрыгнуть? ", "x" + " " * 20 + "7\n", "a, b. ",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)] + [None, "", " \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    register_functions(spark)
    df.createOrReplaceTempView("mixed_texts")
    found = spark.sql("SELECT m.doc_id, s.task_number, s.content FROM mixed_texts m, LATERAL segment_text(m.content) s").collect()
    want = G.segment_submissions(df.na.fill("", ["content"])).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in want} and len(found) == 4 * len(texts)
    assert sum(r.content != "" for r in found) > 400
