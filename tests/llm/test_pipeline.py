"""The corpus pipeline, and the registered queries against their SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from lagloom import llm


def test_stages(spark, sf_dir, docs):
    df, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = df.count()
        out = stage(spark, df, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.dtypes == docs.dtypes
            df = corpus_pipeline.materialize(out, "test")
            assert 0 < df.count() <= before, name
        else:
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == before
    assert corpus_pipeline.run(spark, sf_dir).count() == df.count()


def test_odd_rows_go_through(spark, sf_dir, odd, none):
    for df, least in ((odd, 5), (none, 0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = corpus_pipeline.materialize(stage(spark, df, sf_dir), "odd")
        ids = [r.doc_id for r in df.collect()]
        assert len(ids) >= least and len(set(ids)) == len(ids)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    want = con.execute(llm.oracle_sql()[name]).df()
    got = llm.queries()[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert sorted(got.columns) == columns and rows(got) == rows(want)
