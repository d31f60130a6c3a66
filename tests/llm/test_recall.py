"""Changed benchmark items against an exhaustive search by longest common subsequence."""

import random

import numpy as np
import pytest

from tests.llm.conftest import make
from threadloom.llm import decontaminate


def corpus(seed=11):
    """Items of common words and of rare ones, planted with changed, dropped and added words among prose of the same vocabulary."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    prose = lambda n: r.choices(vocab, weights, k=n)
    items = [(k, prose(r.randint(25, 60)) if k % 2 else r.choices(vocab[:60], k=40)) for k in range(40)]
    docs = []
    for k in range(400):
        words = prose(r.randint(20, 200))
        if k % 4 == 0:
            item = list(items[k // 4 % 40][1])
            for _ in range(len(item) // 5):
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice([[r.choice(vocab)], [], [item[at], r.choice(vocab)]])
            at = r.randrange(len(words))
            words[at:at] = item
        docs.append((k, " ".join(words)))
    return [(k, " ".join(w)) for k, w in items], docs


def exhaustive(items, docs):
    """Pairs that pass the checks somewhere, whatever their cosine."""
    block = decontaminate.Items(items)
    idf = np.ones(len(block.terms))
    found = set()
    for k, text in docs:
        words = np.array([block.terms.get(w, -1) for w in decontaminate.words_of(text)], np.int32)
        for j in range(len(items)):
            last = max(0, -(-len(words) // decontaminate.TILE) - 1)
            if decontaminate._confirm(block, idf, words, (k, 0, 0, j, 1.0, last), decontaminate.COVER, decontaminate.ANSWER):
                found.add((k, items[j][0]))
    return found


def test_recall(spark):
    items, docs = corpus()
    every = exhaustive(items, docs)
    assert len(every) >= 80
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(make(spark, docs), bench).collect()}
    assert len(got & every) >= 0.95 * len(every)


@pytest.mark.parametrize("rows", [7, 4096])
def test_dense_columns_change_nothing(monkeypatch, rows):
    """Products with any share of dense columns and any stretch of passages are the plain ones."""
    monkeypatch.setattr(decontaminate, "ROWS", rows)
    r = np.random.default_rng(0)
    counts = r.integers(0, 3, (50, 30)) * (r.random((50, 30)) < 0.3)
    row, term = np.nonzero(counts)
    idf, matrix = r.random(30) + 0.1, r.normal(size=(30, 5)).astype(np.float32)
    plain = np.where(counts > 0, (1 + np.log(np.maximum(counts, 1))) * idf, 0)
    for dense in (np.zeros(30, bool), np.ones(30, bool), r.random(30) < 0.5):
        w, image, back = decontaminate.Weights(idf, dense), [], np.zeros((30, 5))
        for first, n, part in decontaminate._stretches(row, 50):
            parts = w.of(row[part] - first, term[part], counts[row[part], term[part]], n, False)
            image.append(w.times(parts, matrix))
            w.add_back(parts, image[-1], back)
        assert np.allclose(np.concatenate(image), plain @ matrix, atol=1e-4)
        assert np.allclose(back, plain.T @ (plain @ matrix), rtol=1e-3, atol=1e-3)


def test_very_long_text_and_blocks_by_words(spark):
    items, docs = corpus(3)
    filler = " ".join(f"w{k}" for k in range(150_000))
    rows = [(1, f"{filler} {items[0][1]} {filler}"), (None, items[1][1]), (3, " ".join(t for _, t in docs[:50]))]
    bench = spark.createDataFrame(items[:4], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(make(spark, [*rows, *docs[1:200:2]]), bench, block_words=50).collect()}
    assert {(1, items[0][0]), (None, items[1][0])} <= got
