"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of a word after its predecessor, of the word alone, and a uniform share:

    P(w | v) = l2[b] c(v, w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1)

with b the bucket of the context's frequency c(v) (its binary logarithm, rounded down). Of a context that hasn't been seen there is
no first estimate, so l2[0] is 0; each bucket's weights sum to 1. They come from expectation-maximisation on deleted counts: each
training occurrence is held out in turn, taken off all counts, and predicted from the rest. Counts are exact and cover the whole
training part; they are gathered and looked up by request and reply (see chunks.py). For EM the occurrences are summed up in a
table of bounded size over (bucket, two log probabilities to a tenth), whose cells keep the means of their probabilities.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.chunks import pack_chunks, totals, with_totals
from threadloom.llm.common import table
from threadloom.llm.ngram_join import MIX, _stir

BUCKETS = 40
STEPS = 10  # cells are a tenth of a log10 probability wide
FLOOR = 20 * STEPS  # the least cell; one more stands for 0
ROUNDS = 100
START = np.uint64(0x5354415254)
END = np.uint64(0x454E44)


def tokens(text: str) -> np.ndarray:
    """Hashes of the text's words, A-Z lower-cased, and of its end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def pair_keys(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _stir(before * MIX + words)


def _chunk(ids, texts, is_train):
    """All tokens of a chunk, the tokens before them, whether they are for training, and where documents end."""
    each = [tokens(t) for t in texts]
    words = np.concatenate(each)
    ends = np.cumsum([len(x) for x in each])
    before = np.roll(words, 1)
    before[np.concatenate([[0], ends[:-1]])] = START
    train = np.repeat(np.array([is_train(i) for i in ids], bool), [len(x) for x in each])
    return words, before, train, ends


def _train_row(fold_of_test: int):
    def is_train(doc_id) -> bool:
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != fold_of_test

    return is_train


def fit_weights(rows: list, v_size: int) -> np.ndarray:
    """Weights (bucket, 3) of pair, word and uniform share by EM over cells (bucket, n, sum of pair's probabilities, sum of word's).

    A bucket without training occurrences has the weights of the next lower one that has some, or else of the next higher one.
    """
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if not rows:
        return weights
    b, n, p2, p1 = (np.array(c) for c in zip(*rows))
    p = np.stack([p2 / n, p1 / n, np.full(len(b), 1 / (v_size + 1))], 1)
    # half an occurrence each: no weight becomes 0, as unseen words still need one
    half = np.full((BUCKETS, 3), 0.5)
    half[0, 0] = 0
    for _ in range(ROUNDS):
        share = weights[b] * p
        share *= (n / share.sum(1))[:, None]
        new = half + np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], 1)
        weights = new / new.sum(1, keepdims=True)
    seen = np.unique(b)
    above = seen[seen > 0]
    for k in set(range(BUCKETS)) - set(seen.tolist()):
        if k and len(above):
            lower = above[above < k]
            weights[k] = weights[lower[-1] if len(lower) else above[0]]
        elif not k:
            weights[k] = [0.0, *(weights[seen[0], 1:] / weights[seen[0], 1:].sum())]
    return weights


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts that haven't been seen, else 1 and the binary logarithm."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _counts(ids, texts, got, is_train):
    words, before, train, ends = _chunk(ids, texts, is_train)
    pairs = pair_keys(words, before)
    every, at = np.unique(words, return_inverse=True)
    of_word = got[0].astype(np.float64)[at]
    # a token's context is the token before it; there are as many starts as ends
    of_before = np.roll(of_word, 1)
    of_before[np.concatenate([[0], ends[:-1]])] = got[0][np.searchsorted(every, END)]
    _, at = np.unique(pairs, return_inverse=True)
    return words, train, ends, of_word, of_before, got[1].astype(np.float64)[at]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", test_fold: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    Rows whose crc32(id as text) mod 5 is test_fold are held out (a null id counts as empty text); the rest trains. Words are
    divided by ASCII white space, A-Z lower-cased; a null or empty text is the end alone. base_score is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))), score the model's log10 probability. Repeated rows are counted and scored each. With
    no training rows c and N are 0 and the uniform share is all there is. Only id_col and text_col are read, whatever other
    columns are called. An empty table gives an empty result.
    """
    is_train = _train_row(test_fold)
    chunks = pack_chunks(docs, id_col, text_col)

    def request(ids, texts):
        words, before, train, _ = _chunk(ids, texts, is_train)
        out = []
        for kind, keys in ((0, words), (1, pair_keys(words, before))):
            every, at = np.unique(keys, return_inverse=True)
            out.append((kind, every, np.bincount(at, train, len(every)).astype(np.uint64)))
        return out

    replies = totals(chunks, request)
    sums = {r.kind: r for r in replies.groupBy("kind").agg(F.sum("n_keys").alias("v"), F.sum("n_total").alias("n")).collect()}
    n_all, v_size = (int(sums[0].n), int(sums[0].v)) if 0 in sums else (0, 0)

    def histogram(chunk, ids, texts, got):
        _, train, _, word, context, pair = _counts(ids, texts, got, is_train)
        word, context, pair = word[train] - 1, context[train] - 1, pair[train] - 1

        def cell(p):
            with np.errstate(divide="ignore"):
                return np.where(p > 0, np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), FLOOR), FLOOR + 1).astype(np.int64)

        p2, p1 = pair / np.maximum(context, 1), word / max(n_all - 1, 1)
        code, at = np.unique((bucket(context) * 1000 + cell(p2)) * 1000 + cell(p1), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.bincount(at, minlength=len(code))), *(pa.array(np.bincount(at, p, len(code))) for p in (p2, p1))], ["code", "n", "p2", "p1"])

    # a few thousand cells, whatever the corpus
    hist = with_totals(chunks, replies, histogram, "code long, n long, p2 double, p1 double").groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n", "p2", "p1")))
    weights = fit_weights([(r.code // 10**6, r.n, r.p2, r.p1) for r in hist.orderBy("code").collect()], v_size)

    def score(chunk, ids, texts, got):
        words, train, ends, word, context, pair = _counts(ids, texts, got, is_train)
        w = weights[bucket(context)]
        # without training rows the uniform share is all
        p = (w if n_all else np.array([[0.0, 0.0, 1.0]]))[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n_all, 1) + w[:, 2] / (v_size + 1)
        base = np.log10((word + 0.5) / (n_all + 0.5 * (v_size + 1)))
        starts = np.concatenate([[0], ends[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([not is_train(i) for i in ids]), pa.array((ends - starts).astype(np.int64)), pa.array(add((word > 0).astype(np.int64))), pa.array(np.full(len(ids), n_all)), pa.array(add(base)), pa.array(add(np.log10(p)))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_totals(chunks, replies, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scores(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
