"""Registered queries: SQL twins, and the pipeline's stages against the operators' own brute-force properties."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from markwell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "labels", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = con.execute(ORACLES[name]).df()
    found = QUERIES[name](spark, SF).toPandas()
    key = list(expected.columns[:2])
    expected, found = (x[sorted(expected.columns)].sort_values(key).reset_index(drop=True) for x in (expected, found))
    pd.testing.assert_frame_equal(found, expected, check_dtype=False)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        kept.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] == sizes[2] < sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    tokens = packed.groupBy("doc_id").sum("length").count()
    assert tokens == docs.select("doc_id").distinct().count()
