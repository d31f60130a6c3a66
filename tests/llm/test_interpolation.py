"""The language model against a plain one with dictionaries, and the sum of its probabilities."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.conftest import make
from threadloom.llm import lm_scores

SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate(SPACES).split(" ") if w] + [None]


def is_train(i):
    return zlib.crc32(str(i).encode()) % 5 != 1


def model(texts):
    """Counts, and weights by EM over single occurrences; (probability, weights)."""
    train = [tokens(t) for i, t in texts if is_train(i)]
    word, pair = Counter(w for ws in train for w in ws), Counter()
    context = Counter()
    for ws in train:
        for v, w in zip(["<s>", *ws], ws):
            pair[v, w] += 1
            context[v] += 1
    context["<s>"] = word[None]
    n, size = sum(word.values()), len(word)
    bucket = lambda c: 0 if c <= 0 else 1 + int(math.log2(c))
    rows = []
    for ws in train:
        for v, w in zip(["<s>", *ws], ws):
            c = context[v] - 1
            rows.append((bucket(c), (pair[v, w] - 1) / max(c, 1), (word[w] - 1) / (n - 1)))
    b = np.array([x[0] for x in rows])
    p = np.array([[x[1], x[2], 1 / (size + 1)] for x in rows])
    weights = np.tile([0.4, 0.5, 0.1], (40, 1))
    weights[0] = [0, 0.8, 0.2]
    half = np.full((40, 3), 0.5)
    half[0, 0] = 0
    for _ in range(lm_scores.ROUNDS):
        share = weights[b] * p
        share /= share.sum(1, keepdims=True)
        new = half + np.stack([np.bincount(b, share[:, k], 40) for k in range(3)], 1)
        weights = new / new.sum(1, keepdims=True)
    seen = sorted(set(b.tolist()))
    for k in range(1, 40):
        if k not in seen:
            weights[k] = weights[max((s for s in seen if 0 < s < k), default=min(s for s in seen if s))]

    def probability(v, w):
        x = weights[bucket(context[v])]
        return x[0] * pair[v, w] / max(context[v], 1) + x[1] * word[w] / n + x[2] / (size + 1)

    return probability, word


def corpus():
    r = random.Random(2)
    vocab = [f"Wörd{k}" if k % 7 else f"Word{k}" for k in range(120)]
    text = lambda n: "".join(r.choice(vocab[: r.choice([5, 40, 120])]) + r.choice([" ", "\n", "\t ", "  "]) for _ in range(n))
    rows = [(k, text(r.randint(0, 80))) for k in range(150)]
    return [*rows, (200, None), (201, ""), (202, rows[3][1]), (203, text(3000))]


def test_scores_are_those_of_the_plain_model(spark):
    texts = corpus()
    probability, _ = model(texts)
    got = {x.doc_id: x for x in lm_scores.score_texts(make(spark, texts)).collect()}
    for i, t in texts:
        ws = tokens(t)
        want = sum(math.log10(probability(v, w)) for v, w in zip(["<s>", *ws], ws))
        assert got[i].n_tokens == len(ws) and abs(got[i].score - want) < 2e-3 * abs(want), i


def test_probabilities_sum_to_one():
    probability, word = model(corpus())
    for v in ("<s>", "wörd1", "word7", "never seen"):
        assert abs(sum(probability(v, w) for w in [*word, "unknown"]) - 1) < 1e-9


def test_weights_of_buckets_without_occurrences():
    w = lm_scores.fit_weights([(2, 10, 5.0, 1.0), (4, 10, 1.0, 1.0)], 50)
    assert np.allclose(w.sum(1), 1) and (w[:, 1:] > 0).all()
    assert (w[1] == w[2]).all() and (w[3] == w[2]).all() and (w[9] == w[4]).all() and w[0, 0] == 0
