"""What the coding of words and the products with rare terms need, beside their results."""

import tracemalloc

import numpy as np
import pyarrow as pa

from threadloom.llm import decontaminate


def peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_rare_terms_take_no_row_of_the_matrix_for_each_entry():
    r = np.random.default_rng(2)
    n_rows, n_terms, rank = 4096, 600, 64
    counts = r.integers(1, 4, (n_rows, n_terms)) * (r.random((n_rows, n_terms)) < 0.05)
    row, term = np.nonzero(counts)
    times, idf, matrix = counts[row, term], r.random(n_terms) + 0.1, r.normal(size=(n_terms, rank)).astype(np.float32)
    w = decontaminate.Weights(idf, np.zeros(n_terms, bool))
    parts = w.of(row, term, times, n_rows, False)
    plain = np.where(counts > 0, (1 + np.log(np.maximum(counts, 1))) * idf, 0)
    image, back = w.times(parts, matrix), np.zeros((n_terms, rank))
    w.add_back(parts, image, back)
    assert np.allclose(image, plain @ matrix, atol=1e-3)
    assert np.allclose(back, plain.T @ image, rtol=1e-3, atol=1e-2)
    each = len(row) * rank * 4
    assert peak(lambda: w.times(parts, matrix)) < each / 4
    assert peak(lambda: w.add_back(parts, image, back)) < each / 4


def test_words_are_coded_without_numbers_for_each_byte():
    texts = ["", "The first, the LAST", "word", "word next", "", "--", "naïve Ünder\x00score x\n\ty" + " plainly common words of prose" * 5000, "end-"]
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw])
    terms = [b"the", b"word", "naïve".encode(), "Ünder".encode(), b"x", b"common", b"end"]
    names = pa.array(terms, pa.binary())
    coded = decontaminate.Coded(data, ends, names)
    for k, t in enumerate(texts):
        assert coded.of(k).tolist() == [terms.index(w) if w in terms else -1 for w in decontaminate.words_of(t)]
    assert peak(lambda: decontaminate.Coded(data, ends, names)) < 16 * len(data)
