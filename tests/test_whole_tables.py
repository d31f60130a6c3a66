"""Queries look at all rows of their tables, on fixtures larger than the smallest test tables."""

from dataclasses import replace

import pytest

from threadloom.operators import fts, search
from threadloom.plans import catalog


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """1,200 documents; those with the highest ids say the searched words most often."""
    at = str(tmp_path_factory.mktemp("many"))
    docs = [(k, f"w{k} x{k} y{k}" + " thing" * (2 * (k >= 1100 and k % 2) or k % 20 == 1), "en" if k % 3 else "fr", "s") for k in range(1200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    vectors = [(k, [1.0, k / 1200], k % 4) for k in range(1200)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["rerank_pool", "rerank_boost"])
def test_pool_is_of_all_documents(spark, many, name):
    rows = catalog.QUERIES[name](spark, many).collect()
    assert {r.msg_id for r in rows} == set(range(1101, 1200, 2))
    assert sorted(r.bm25_rank for r in rows) == sorted(r.semantic_rank for r in rows) == list(range(50))


def test_batch_ranks_ties_by_id_before_its_cut(spark):
    """Scores that differ in their last digits only are equal, so the least ids are kept."""
    postings = spark.createDataFrame([("word", k, 1) for k in range(30)], "term string, msg_id long, tf int")
    stats = spark.createDataFrame([(k, 10**9 - k) for k in range(30)] + [(100 + k, 10**9) for k in range(100)], "msg_id long, dl long")
    empty = fts.index(spark.createDataFrame([], "msg_id long, content string"), stemmed=False)
    idx = replace(empty, postings=postings, doc_stats=stats)
    rows = search.search_batch(idx, spark.createDataFrame([(1, "word")], "query_id long, text string"), top=3).collect()
    assert [r.msg_id for r in sorted(rows, key=lambda r: r["rank"])] == [0, 1, 2]
