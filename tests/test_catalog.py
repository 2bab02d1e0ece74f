"""Every registered query against its oracle at the smallest scale (set MARKWELL_ALL=1 for all of them)."""

import importlib
import os

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
from tools.check_queries import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUICK = (
    "flagship_assessment", "segment_submissions", "evaluate_answers", "llm_likelihood", "top_similar", "ingest_dedup",
    "statistics", "leaderboard", "list_numbering", "action_log", "stream_latest_stage", "tfidf_keywords",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("MARKWELL_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data is not there")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_inventory_is_covered():
    ids = {item.inventory_id for item in importlib.import_module("markwell.plans").load_catalog().values()}
    wanted = {f"S{i}" for i in range(1, 16)} | {f"N{i}" for i in range(1, 22)} | {f"X{i}" for i in range(1, 13)}
    wanted |= {f"C{i}" for i in range(1, 6)} | {f"E{i}" for i in range(1, 15)} | {f"I{i}" for i in range(1, 9)}
    wanted |= {f"G{i}" for i in range(1, 20)} | {f"P{i}" for i in range(1, 10)} | {f"L{i}" for i in range(1, 13)}
    wanted |= {f"A{i}" for i in range(1, 10)} | {f"W{i}" for i in range(1, 8)} | {f"T{i}" for i in range(1, 8)}
    wanted |= {f"U{i}" for i in range(1, 6)}
    assert wanted - ids == set()
