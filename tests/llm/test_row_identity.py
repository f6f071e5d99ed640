"""Stages of the pipeline on rows without ids and on several texts under one id."""

import corpus_pipeline

A, B, C, D = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")


def test_groups_keep_one_row_each(spark, sf_dir):
    rows = [(None, A), (None, A), (1, B), (1, C), (1, C), (2, C), (3, D), (None, D)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(None, A), (1, B), (1, C), (3, D)], key=str)


def test_leaks_go_by_text(spark, sf_dir):
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("size(split(text, ' ')) > 15").first().text
    df = spark.createDataFrame([(None, leak), (1, leak), (1, A), (None, B)], "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.benchmark_leaks(spark, df, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(1, A), (None, B)], key=str)
