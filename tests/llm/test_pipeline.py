import os

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.conftest import make

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_on_odd_rows(spark):
    rows = [(k, f"Some words of document {k}, quite clean and of some length, as prose is.\nSecond line {k}.") for k in range(12)]
    odd = make(spark, [*rows, (3, rows[3][1]), (50, None), (51, ""), (None, "text")]).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", "n", "h")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, DATA)
            assert out.columns == corpus_pipeline.COLUMNS, name
            out.collect()
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, odd, DATA).collect()}
    assert kept >= {50, 51} and 3 in kept


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run(spark):
    pieces = corpus_pipeline.run(spark, DATA)
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    rows = pieces.collect()
    assert rows and {r.doc_id for r in rows} <= ids
    assert len({r.doc_id for r in rows}) > 0.5 * len(ids)
