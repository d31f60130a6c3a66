"""The decontamination stage and documents without an id."""

import random

import corpus_pipeline


def test_leak_in_a_document_without_id_goes(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    item = " ".join(word() for _ in range(40)) + "."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    other = lambda: " ".join(word() for _ in range(60))
    rows = [(None, f"{other()} {item} {other()}"), (1, f"{other()} {item}"), *((k, other()) for k in range(2, 40))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()} == set(range(2, 40))
