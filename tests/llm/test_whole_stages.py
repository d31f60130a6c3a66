"""Stages and operators on what a cut would leave out."""

import corpus_pipeline
from tests.llm.conftest import make


def test_near_copies_of_five_words(spark):
    words = [f"w{k}" for k in range(120)]
    rows = [(1, " ".join(words[:100])), (2, " ".join(words)), (3, " ".join(words[:100] + [f"v{k}" for k in range(40)]))]
    docs = make(spark, rows).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    # 96 of 116 shingles are in 1 and 2, 96 of 136 in 1 and 3
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, None).collect()} == {1, 3}
