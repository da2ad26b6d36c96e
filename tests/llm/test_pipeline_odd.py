"""Odd tables through all stages of the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, None), (2, ""), (3, " \t"), (None, "some words that nobody else has here"), (4, "alpha beta gamma delta epsilon zeta eta"), (4, "alpha beta gamma delta epsilon zeta eta"), (5, "long " * 40_000)]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_take_odd_tables(spark, tmp_path, rows):
    d = str(tmp_path)
    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None) for k, (i, t) in enumerate(rows)], SCHEMA)
    for n in ("cls", "c", "n", "words", "size", "mark", "keep", "spans", "target", "_text"):
        docs = docs.withColumn(n, F.lit("own"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, d).write.parquet(f"{d}/{k}")
        now = spark.read.parquet(f"{d}/{k}")
        assert set(docs.columns) <= set(now.columns)
        counts.append(now.count())
    assert counts[:4] == ([7, 6, 6, 6] if rows else [0] * 4)
    assert {r.c for r in now.collect()} <= {"own"}
