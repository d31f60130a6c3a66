"""Components of vectors beyond 32 bits."""

import random

import pytest

from threadloom.llm import knn

VECTORS = "vec_id long, embedding array<double>"


def test_knn_beyond_32_bits(spark):
    r = random.Random(3)
    rows = [(k, [r.uniform(-3e8, 3e8) if k > 20 and k % 3 else r.uniform(-2, 2) for _ in range(3)]) for k in range(150)]
    whole = {k: [int(64 * x // 1) for x in v] for k, v in rows}
    queries = [row for row in rows if row[0] < 20]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in knn.top_k(spark.createDataFrame(queries, VECTORS), df, k=7, pivots=5, block=16).collect())
    want = []
    for q, _ in queries:
        every = sorted((-sum(a * b for a, b in zip(whole[q], whole[k])), k) for k in whole if k != q)[:7]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(every, 1)]
    assert got == want
    big = spark.createDataFrame([(1, [3e9]), (2, [3e9])], VECTORS)
    with pytest.raises(Exception, match="exceed 64 bits"):
        knn.top_k(big, big).collect()


def test_lengths_repeats_and_names(spark):
    rows = [(20, [1.0, 0.0]), (40, [1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0]), (3, [0.5, 9.0]), (None, [1.0, 1.0]), (4, []), (5, None), (6, [float("nan"), 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, b"") for i, v in rows], VECTORS + ", cell long, block long, vectors binary")
    got = sorted(tuple(x) for x in knn.top_k(df.where("vec_id % 20 = 0"), df, pivots=2).collect())
    assert got == [(20, 1, 1, 4096), (20, 2, 1, 4096), (20, 3, 3, 2048), (40, 1, 2, 8192)]


def test_one_cell_with_most_vectors(spark):
    r = random.Random(9)
    rows = [(k, [1.0, 1.0, r.choice([0.0, 0.015625])] if k % 3 else [r.uniform(-2, 2) for _ in range(3)]) for k in range(400)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    whole = {k: [int(64 * x // 1) for x in v] for k, v in rows}
    got = sorted(tuple(x) for x in knn.top_k(df.where("vec_id % 20 = 0"), df, k=9, pivots=6, block=10).collect())
    want = []
    for q in range(0, 400, 20):
        every = sorted((-sum(a * b for a, b in zip(whole[q], whole[k])), k) for k in whole if k != q)[:9]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(every, 1)]
    assert got == want
