import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import make
from threadloom.llm import decontaminate, knn, lm_scores, quality


def folded(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None]


def test_lm(docs, texts, nothing):
    got = lm_scores.score_texts(docs).collect()
    train = [words(t) for i, t in texts if folded(i) != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, folded(i) == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, t in texts for w in [words(t)])
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    mean = lambda h, k: sum(r[k] for r in got if r.held_out == h) / sum(r.n_tokens for r in got if r.held_out == h)
    assert mean(False, "score") > mean(False, "base_score") and mean(True, "score") > mean(True, "base_score")
    assert lm_scores.score_texts(nothing).count() == 0


def test_lm_probabilities_sum_to_one():
    weights = lm_scores.fit_weights([(1, 100, 100 * 10**-0.5, 1.0), (1, 50, 0.0, 50 * 10**-3.0), (3, 70, 70 * 10**-0.2, 7.0)], 1000)
    assert np.allclose(weights.sum(1), 1) and (weights[1:] > 0).all() and (weights[0, 1:] > 0).all() and weights[0, 0] == 0
    # where pairs predict well they weigh more
    assert weights[3, 0] > weights[1, 0]


def test_knn(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 8))
    x[50:120] = x[50]  # one vector many times
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 8), (1002, [1.0]), (None, x[0].tolist()), (1003, [None] * 8), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for q in knn.top_k(df.where("vec_id % 20 = 0"), df, pivots=9, block=32).collect():
        got.setdefault(q.query_id, []).append((q["rank"], q.vec_id, q.score))
    whole = np.floor(64 * x).astype(int)
    for q in range(0, 400, 20):
        s = whole @ whole[q]
        best = sorted((-s[k], k) for k in range(400) if k != q)[:20]
        assert sorted(got[q]) == [(i + 1, k, -v) for i, (v, k) in enumerate(best)]
    assert set(got) == set(range(0, 400, 20))
    assert knn.top_k(df.limit(0), df.limit(0)).count() == 0
    assert knn.top_k(df.limit(0), df).count() == 0
    few = df.where("vec_id < 3")
    assert knn.top_k(few, few).count() == 6


def test_quality_learns_and_generalises(spark, nothing):
    r = random.Random(0)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n)) + "."

    def bad(k):
        return (prose(120).upper().replace(" ", "!! "), prose(60) + " " + " ".join([r.choice(vocab)] * 120), " | ".join(prose(3) for _ in range(60)))[k % 3]

    rows = [(k, bad(k) if k % 4 == 0 else prose(r.randint(5, 300))) for k in range(400)] + [(900, ""), (901, None), (None, "text")]
    df = make(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(400)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(df, labels, max_train=250)
    got = quality.score_quality(df, model, keep=["doc_id", "n", "a"]).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    held = [x for x in got if x.doc_id is not None and x.doc_id < 400 and folded(x.doc_id) == 0]
    assert np.mean([x.predicted == int(x.doc_id % 4 != 0) for x in held]) > 0.95
    assert quality.score_quality(nothing, model).count() == 0
    untrained = quality.fit_quality(nothing, labels.limit(0))
    assert 0 <= untrained.score(*quality.encode_passages(["some text", ""]))[1] <= 1


def test_quality_gradients():
    m = quality.AttentionBags()
    x, n = quality.encode_passages(["One text. " * 100, "ANOTHER!! " * 90, ""])
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(m.score(x, n)) + (1 - y) * np.log(1 - m.score(x, n)))
    before = loss()
    m.fit(x.astype(float), n, y, epochs=60)
    assert loss() < 0.5 * before


def test_passages_of_a_text_do_not_depend_on_others():
    a, n = quality.encode_passages(["first text here", "", "x" * 1000])
    b, k = quality.encode_passages(["x" * 1000])
    assert list(n) == [1, 1, 3] and np.allclose(a[2:], b) and list(k) == [3]


def test_decontamination(spark, nothing):
    r = random.Random(6)
    vocab = ["".join(r.choice(["th", "er", "on", "an", "re", "ti", "ou"]) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, prose(r.randint(12, 25)) + ". " + prose(r.randint(6, 12)) + ".") for k in range(30)]

    def changed(t, every):
        return " ".join(f"new{k}" if k % every == 2 else w for k, w in enumerate(t.split()))

    rows, want = [], set()
    for k in range(200):
        t = prose(r.randint(0, 400))
        if k % 10 == 0:
            item = items[k // 10]
            t = f"{t} {item[1].upper() if k % 20 == 0 else changed(item[1], 6)} {prose(r.randint(0, 60))}"
            want.add((k, item[0]))
        elif k % 10 == 1:  # a third of an item is no leak
            w = items[k // 10][1].split()
            t += " " + " ".join(w[: len(w) // 3])
        rows.append((k, t))
    df = make(spark, [*rows, (900, None), (901, ""), (None, None), rows[0]])
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "x y")], "item_id long, text string")
    got = decontaminate.find_leaks(df, bench)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    halves = decontaminate.find_leaks(df, bench, block_items=20)
    assert {(x.doc_id, x.item_id) for x in halves.collect()} == want
    assert decontaminate.find_leaks(nothing, bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_lcs():
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        n, begin, end = decontaminate.lcs_span(np.array(a), np.array(b))
        assert n == table[-1][-1] == decontaminate.lcs_length(a, b) and 0 <= begin <= end <= len(b) and end - begin >= n


@pytest.mark.parametrize("rank", [2, 8])
def test_basis_spans_the_largest_directions(rank):
    r = np.random.default_rng(0)
    a = r.normal(size=(50, rank)) @ r.normal(size=(rank, 20))
    omega = r.normal(size=(20, 12))
    v = decontaminate._basis(a.T @ a @ omega, omega)
    assert np.linalg.norm(a - a @ v @ v.T) < 1e-2 * np.linalg.norm(a)
