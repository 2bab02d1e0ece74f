import pytest
from pyspark.sql import functions as F

from markwell.functions.sqlfuncs import register_functions
from markwell.operators import grading as G
from markwell.operators import lifecycle as L
from markwell.operators import ranking as R
from markwell.operators import reports as P
from markwell.operators import statistics as A
from markwell.operators.criteria import Criterion
from markwell.sources import answers_json as J
from markwell.sources import exports as E
from markwell.sources import files as S


@pytest.fixture()
def subs(spark):
    rows = [
        (1, "a.txt", "h1", "completed", 1, 9.0, None, "note"), (2, "b.txt", "h2", "completed", 1, 9.0, None, " "),
        (3, "c.txt", "h3", "error", 1, 9.9, None, "note"), (4, "d.txt", "h4", "completed", 0, 8.0, None, None),
        (5, "e.txt", "h5", "pending", 1, None, "winner", "note"), (6, "f.txt", "h6", "completed", 1, 0.0, None, "note"),
    ]
    return spark.createDataFrame(
        rows,
        "doc_id long, full_filename string, file_hash string, processing_status string, approved int, average_score double,"
        " candidate_status string, overall_impression string",
    ).withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "doc_id long")


def test_winners_break_ties_and_keep_old_ones(subs):
    got = {r.doc_id: r.candidate_status for r in R.select_winners(subs, 2).collect()}
    assert got == {1: "winner", 2: "winner", 3: None, 4: None, 5: "winner", 6: None}
    with pytest.raises(ValueError):
        R.winners(subs, 0)


def test_leaderboard_and_status(subs):
    assert [r.doc_id for r in R.leaderboard(subs).orderBy("place").collect()] == [1, 2, 5, 6, 4, 3]
    got = {r.doc_id: r.row_status for r in R.row_status(subs, 2).collect()}
    # the blocked document 3 takes the first of the two places, as it is approved and scored
    assert got == {1: "top_n_approved", 2: "read", 3: "blocked", 4: "unread", 5: "winner", 6: "unread"}


def test_gate_and_batches(spark, subs):
    out = {r.doc_id: (r.approved, r.approval) for r in L.approve_gated(subs, ids(spark, 2, 4, 6, 99)).collect()}
    assert out[2] == (1, "rejected") and out[4] == (0, "rejected") and out[6] == (1, "approved") and out[1] == (1, None)
    blocked = L.batch_set_status(subs, ids(spark, 1, 1, 99), "block")
    assert blocked.filter("changed").count() == 1
    with pytest.raises(ValueError):
        L.batch_set_status(subs, ids(spark, 1), "nope")
    assert L.batch_delete(subs, ids(spark, 1, 2)).count() == 4


def test_upsert(spark, subs):
    base = subs.select("doc_id", "approved", "average_score").withColumn("updated_at", F.lit("old"))
    changes = spark.createDataFrame([(1, 0, None), (77, 1, 1.0)], "doc_id long, approved int, average_score double")
    out = {r.doc_id: tuple(r)[1:] for r in L.upsert(base, changes, F.lit("new")).collect()}
    assert out[1] == (0, 9.0, "new") and out[2] == (1, 9.0, "old") and 77 not in out
    assert L.upsert(base, changes.select("doc_id"), F.lit("new")) is base


def test_dedup(spark, subs):
    batch = spark.createDataFrame([(11, "x", "h1"), (12, "y", "n"), (13, "z", "n")], "doc_id long, full_filename string, file_hash string")
    got = {r.doc_id: (r.outcome, r.existing_id, r.existing_name) for r in L.ingest_dedup(subs, batch).collect()}
    assert got == {11: ("duplicate", 1, "a.txt"), 12: ("accepted", None, None), 13: ("duplicate", 12, "y")}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 2.0, 4.0, 6.0, 8.0, 10.0, None)], "average_score double")
    assert [(r.bin, r.n) for r in A.score_histogram(df).collect()] == [("0-2", 1), ("2-4", 1), ("4-6", 1), ("6-8", 1), ("8-10", 2)]


def test_lists_and_lookup(subs):
    assert [r.doc_id for r in L.list_documents(subs, limit=2, offset=1).collect()] == [2, 3]
    assert [r.doc_id for r in L.list_documents(subs, offset=4).collect()] == [5, 6]
    assert L.lookup(subs.withColumn("filename", F.lit("q")), "name", "b.txt").first().doc_id == 2
    assert L.lookup(subs, "doc_id", 42).count() == 0


def test_messages(subs):
    s = subs.withColumn("messages_sent", F.lit(0))
    assert R.message_summary(s).first().all_sent is False
    assert R.message_summary(R.mark_messages_sent(s)).first().all_sent is True
    assert R.message_summary(s.filter("doc_id = 1")).first().error == "No winners found"


def test_contests(spark):
    good = '{"name":"n","is_active":1,"tasks":{"1":{"task_text":"t","criteria":[{"criterion_number":1,"criterion_text":"c"},{"criterion_number":2}]}}}'
    rows = [(1, good), (2, good.replace('"1":{', '"9":{')), (3, "{}"), (4, good.replace('"t"', '" "')), (5, "oops")]
    parsed = L.parse_contests(spark.createDataFrame(rows, "contest_id int, config string"))
    errors = {r.contest_id: r.error for r in parsed.select("contest_id", "error").collect()}
    assert errors[1] is None and all(errors[i] for i in (2, 3, 4, 5))
    assert [tuple(r) for r in L.contest_criteria(parsed).collect()] == [(1, 1, 1, "c", 1.0)]


def test_evaluation_edges(spark):
    answers = spark.createDataFrame(
        [(1, 1, "alpha beta gamma"), (1, 2, ""), (1, 7, "extra"), (2, 1, "alpha")], "doc_id long, task_number int, content string"
    )
    keys = spark.createDataFrame([("hr", 1, "alpha beta gamma"), ("ai", 1, "alpha beta gamma"), ("hr", 2, "x y")], "kind string, task_number int, content string")
    out = {(r.doc_id, r.task_number): r for r in G.evaluate_answers(answers, keys, {1: (Criterion("c", ("alpha",)),)}).collect()}
    assert set(out) == {(1, 1), (1, 2), (1, 7), (2, 1), (2, 2)}
    best = out[1, 1]
    assert (best.hr_sim, best.chosen, best.cosine_score, best.blended_score, best.final_score) == (1.0, "hr", 10.0, 10.0, 9.0)
    assert out[1, 2].final_score is None and out[1, 2].warning is not None
    assert out[1, 7].chosen is None and out[1, 7].comment.startswith("Нет данных")
    docs = spark.createDataFrame([(1, "d1", "txt"), (3, "d3", "txt")], "doc_id long, filename string, type string")
    evaluation = G.evaluate_answers(answers, keys, {1: (Criterion("c", ("alpha",)),)})
    hr = {r.doc_id: r.report for r in P.hr_report(docs, evaluation, F.lit("T")).collect()}
    assert "Итоговая оценка работы: 9.00" in hr[1] and "=== ПРЕДУПРЕЖДЕНИЯ ===\n• Вопрос 2" in hr[1]
    assert hr[3].endswith("Нет данных оценки (eval_v6).")
    assert "Вопрос 7 (справочно, не учитывается в итоговой оценке)" in hr[1]


def test_manual_grades(spark):
    edits = spark.createDataFrame(
        [(1, 1, "11", None, None, ""), (1, 2, "7.5", None, None, ""), (1, 3, "", None, None, ""), (1, 4, None, "x", None, ""), (1, 9, "1", None, None, "")],
        "doc_id long, task_number int, score string, logic_score string, originality_score string, comment string",
    )
    checked = {(r.task_number): r.valid for r in G.validate_grades(edits).collect()}
    assert checked == {1: False, 2: True, 3: True, 4: False, 9: False}
    base = spark.createDataFrame(
        [(1, 5.0, 5.0, 5.0, 1.0, 1.0, 5.0)],
        "doc_id long, task_1_score double, task_2_score double, task_3_score double, task_4_logic_score double, task_4_originality_score double, average_score_tasks_1_3 double",
    )
    row = G.apply_manual_grades(base, edits).first()
    assert (row.task_1_score, row.task_2_score, row.task_3_score, row.average_score_tasks_1_3) == (5.0, 7.5, None, 6.25)


def test_nested_answer(spark):
    deep = '{"a": [{"b": {"c": [[{"d": "e"}, "f"], [], {}]}}, "g"], "z": 1}'
    cases = [
        ('{"b": {"x": 1, "y": ["p", {"q": true}]}, "a": "t", "n": null}', "b:\nx: 1\ny:\n - p\nq: True\na: t\nn:"),
        ("plain", "plain"), ('["a", "b"]', "- a\n- b"), (None, None), ("[1] see below", "[1] see below"), ("{}", ""), ("", ""),
        (deep, "a:\nb:\nc:\nd: e\n - - f\n - g\nz: 1"), ('["a", "b"]', "- a\n- b"),
    ]
    rows = [(i, t, "other") for i, (t, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, content string, path string")
    got = {r.id: (r.content, r.path) for r in J.flatten_nested(df, "content").collect()}
    assert got == {i: (want, "other") for i, (_, want) in enumerate(cases)}
    nested = '"x"'
    for _ in range(12):
        nested = f'{{"k": [{nested}]}}'
    one = spark.createDataFrame([(nested,)], "content string")
    assert J.flatten_nested(one, "content").first()[0].count("k:") == 12


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("привет".encode("cp1251"))
    (tmp_path / "in" / "b.md").write_bytes("ёж".encode())
    (tmp_path / "in" / "c.exe").write_bytes(b"x")
    (tmp_path / "in" / "d.xls").write_bytes(b"x")
    rows = {r.filename: (r.content, r.error) for r in S.decode_files(S.scan_submissions(spark, str(tmp_path / "in"))).collect()}
    assert rows == {"a.txt": ("привет", None), "b.md": ("ёж", None), "d.xls": (None, "Unsupported file type: xls")}
    (tmp_path / "ref.txt").write_text("x Ответ 1. раз\nответ 2. два Ответ 1. снова")
    got = {r.task_number: r.content for r in S.read_reference_answers(spark, str(tmp_path / "ref.txt")).collect()}
    assert got == {1: "снова", 2: "два"}
    assert S.read_reference_answers(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "p.csv").write_text('task_1,task_3\n"a\nb",c\nx,y\n')
    assert [tuple(r) for r in S.read_task_prompts(spark, str(tmp_path / "p.csv")).collect()] == [(1, "a\nb"), (3, "c")]


def test_log_line(spark):
    row = spark.range(1).select(
        E.render_action(F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit("approve"), F.lit(5), F.lit(None).cast("string"),
                        F.create_map(F.lit("k"), F.lit("v"), F.lit("j"), F.lit("[" + "1" * 300)), F.lit("success")).alias("x")
    ).first()["x"]
    assert row == "[2024-01-02 03:04:05] | Action: approve | Doc ID: 5 | Details: k=v, j=[" + "1" * 199 + "... | Status: success"


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql(
        "SELECT cosine(array(1D, 0D), array(1D, 1D)) a, cosine(NULL, array(1D)) b, l2_normalize(array(3D, 4D)) c,"
        " keyword_hit('The JOIN here', 'join') d, keyword_hit('rejoin', 'join') e, llm_likelihood('1. А 2. Б') f"
    ).first()
    assert row.a == pytest.approx(0.5**0.5) and row.b == 0.0 and row.c == [0.6, 0.8]
    assert (row.d, row.e) == (True, False) and row.f == pytest.approx(0.1)
    parts = spark.sql("SELECT task_number, content FROM segment_text('Вопрос 1. раз Вопрос 2: два') WHERE content <> ''").collect()
    assert [tuple(r) for r in parts] == [(1, "раз"), (2, "два")]
