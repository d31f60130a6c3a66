import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import packing, records, token_counts
from threadloom.llm.wordcodec import WordCodec, tokenizer_path

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
CODECS = {n: (WordCodec(tokenizer_path(n), max_entries=300), WordCodec(tokenizer_path(n), "count")) for n in NAMES}
PARTS = st.lists(st.sampled_from([*"abZ019'.,!?-_|% \n\t é²½ª×÷£\xad\xa0\x85\x0b\x0c\u2003\u3000\u1680İŉſ́ΣςΑ日\x1c\x00’", "'s", "'ll", "<|endoftext|>", "<|", "\r\n", "  ", "\n\n", "hello", "x" * 70]), max_size=40)


@given(st.lists(PARTS.map("".join), min_size=1, max_size=5))
@settings(max_examples=400, deadline=None)
def test_codec_is_the_library(texts):
    for ids, counts in CODECS.values():
        want = [ids.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in ids.encode_texts(texts)] == want
        assert counts.encode_texts(texts) == [len(w) for w in want]


@pytest.mark.parametrize("name", NAMES)
def test_groups_of_a_batch(name):
    """Groups of any size, long texts in pieces, nulls, slices of a batch."""
    r = random.Random(3)
    words = ["word", "Wörter", "don't", "x1y2", "  ", "\n", "\n\n", "\xa0", "end.", "日本", "<|endoftext|>", "a" * 100]
    texts = [None, "", *(" ".join(r.choice(words[: 7 if k % 3 else 12]) for _ in range(r.choice([1, 5, 900]))) for k in range(60)), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(1)
    own = WordCodec(tokenizer_path(name), max_entries=60)
    want = [own.tok.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    for limit in (1, 50, 3000, 1 << 20):
        got = []
        for first, n, ids in own.groups(batch, limit=limit):
            assert first == len(got)
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want


def reference(name, texts):
    tok = CODECS[name][0].tok
    return [tok.encode(t or "", add_special_tokens=False).ids for _, t in texts]


def test_counts(docs, texts, nothing):
    want = Counter((i, len((t or "").encode()), len(e), len(e) > 2048) for (i, t), e in zip(texts, reference(NAMES[1], texts)))
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs).collect()) == want
    assert token_counts.count_tokens(nothing).count() == 0


def test_records_round_trip(docs, texts, nothing, tmp_path):
    files = records.write_records(docs, f"file://{tmp_path}/r", partitions=3)
    got = [tuple(r) for r in records.read_digests(files).collect()]
    want, start = [], 0
    for (i, _), ids in sorted(zip(texts, reference(NAMES[0], texts)), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] is not None, x[0][1] or "")):
        ids = np.array([*ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert Counter(got) == Counter(want)
    path = files.orderBy("part").first().path
    every = list(records.read_records(path))
    order = list(range(len(every)))
    random.Random(0).shuffle(order)
    for k, (i, ids) in zip(order, records.read_at(path, order)):
        assert i == every[k][0] and (ids == every[k][1]).all()
    assert records.read_digests(records.write_records(nothing, f"file://{tmp_path}/e")).count() == 0


def test_records_notice_damage(docs, tmp_path):
    path = records.write_records(docs.limit(5), f"file://{tmp_path}/d", partitions=1).first().path
    name = path.removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[30] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(ValueError):
        list(records.read_records(path))
    open(name, "wb").write(data[:7])
    with pytest.raises(ValueError):
        list(records.read_records(path))


def test_packing(docs, texts, nothing):
    rows = packing.pack(docs, partitions=2).collect()
    want = Counter()
    for (i, _), ids in zip(texts, reference(NAMES[1], texts)):
        want[i, len(ids) + 1] += len(ids) + 1
    got = Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == want
    by_id = {i: np.array([*ids, 2], "<u4") for (i, _), ids in zip(texts, reference(NAMES[1], texts)) if i is not None}
    for r in rows:
        if r.doc_id is not None:
            assert zlib.crc32(by_id[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 4096
    assert sum(packing.padding(n) for n in sequences.values()) < 0.01 * sum(sequences.values())
    assert packing.pack(nothing).count() == 0


def test_cuts_are_the_best():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 14)
        at = sorted(r.sample(range(1, 60), n))
        at = [0, *at]
        if max(b - a for a, b in zip(at, at[1:])) > 16:
            continue
        penalty = [0.0] + [r.choice([0.0, 2.0, 5.0]) for _ in at[1:]]
        best = [0.0] + [None] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + packing.padding(at[j] - at[i], 16) + penalty[j] + packing.PER_WINDOW for i in range(j) if at[j] - at[i] <= 16 and best[i] is not None)
        assert packing.best_cuts(at, penalty, 16)[0] == pytest.approx(best)


def test_long_stretches_stay_bounded():
    p = packing.Packer(0, np.zeros(10, bool), 64)
    rows, largest = [], 0
    for k in range(3000):
        rows += p.add(k, np.full(k % 50 + 1, 3, "<u4"))
        largest = max(largest, p.size)
    rows += p.solve(True)
    assert sum(r[2] for r in rows) == sum(k % 50 + 1 for k in range(3000)) and largest <= (packing.STRETCH + packing.SETTLED + 4) * 64
