"""Packing into sequences of at most 4096 tokens by order-preserving dynamic programming.

Documents keep their order; a sequence is a window of the stream of their tokens. Windows may end at the end of a document for
nothing, at the end of a sentence for a small penalty, and inside a sentence (only where a sentence is long) for a larger one.
A window of n tokens is padded to the full length, except if n is a power of two. With c the place of a cut and f its least cost,

    f(j) = penalty(j) + per_window + min( full - c(j) + min over c(j) - full <= c(i) < c(j) of f(i) + c(i),
                                          min over powers 2^k of f(cut at c(j) - 2^k) )

The inner minimum over a sliding window comes from a monotone queue, so a cut costs a constant number of steps. A task works on
its range of documents and holds a bounded stretch of tokens (and the longest document): cuts that lie well before the stretch's
end are final, the rest is solved again with what follows.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from threadloom.llm.common import in_id_order, shuffle_partitions, table
from threadloom.llm.wordcodec import codec, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
FULL = 4096
#: Penalties in tokens of padding: a window at all, a cut after a sentence, a cut elsewhere.
PER_WINDOW, AT_SENTENCE, INSIDE = 4.0, 8.0, 48.0
STRETCH = 96
SETTLED = 12


def candidates(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, full: int = FULL) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible cuts, from 0 to total, and their penalties. Where a sentence leaves a gap of over full / 16, places inside it are added."""
    at = np.unique(np.concatenate([[0, total], doc_ends, sentence_ends])).astype(np.int64)
    at = at[at <= total]
    penalty = np.full(len(at), AT_SENTENCE)
    penalty[np.isin(at, doc_ends)] = 0.0
    penalty[0] = 0.0
    gaps = np.diff(at)
    step = max(1, full // 32)
    extra = [np.arange(at[k] + step, at[k + 1], step) for k in np.flatnonzero(gaps > 2 * step)]
    if extra:
        more = np.concatenate(extra)
        at, penalty = np.concatenate([at, more]), np.concatenate([penalty, np.full(len(more), INSIDE)])
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, full: int = FULL) -> tuple[list[float], list[int]]:
    """Least cost of each cut and the cut before it."""
    at = np.asarray(at, np.int64)
    # the cuts that lie a power of two before each cut: (cut, earlier cut), in the order of cuts
    pairs = [np.empty((0, 2), np.int64)]
    for k in range(full.bit_length()):
        if 1 << k < full:
            there = np.searchsorted(at, at - (1 << k))
            hit = np.flatnonzero(at[np.minimum(there, len(at) - 1)] == at - (1 << k))
            pairs.append(np.stack([hit, there[hit]], 1))
    every = np.concatenate(pairs)
    every = every[np.argsort(every[:, 0], kind="stable")]
    upto = np.searchsorted(every[:, 0], np.arange(len(at)), "right").tolist()
    earlier, place, add = every[:, 1].tolist(), at.tolist(), (np.asarray(penalty, float) + PER_WINDOW).tolist()
    cost, back = [0.0] * len(place), [0] * len(place)
    queue: deque[tuple[float, int, int]] = deque([(float(place[0]), 0, place[0])])
    pop, push, drop = queue.pop, queue.append, queue.popleft
    done = upto[0]
    for j in range(1, len(place)):
        c = place[j]
        low = c - full
        while queue[0][2] < low:
            drop()
        best, i, _ = queue[0]
        # a full window is a power of two as well: the head's padding is nothing then
        best += full - c
        while done < upto[j]:
            k = earlier[done]
            if cost[k] < best:
                best, i = cost[k], k
            done += 1
        best += add[j]
        cost[j], back[j] = best, i
        g = best + c
        while queue and queue[-1][0] >= g:
            pop()
        push((g, j, c))
    return cost, back


def padding(n: int, full: int = FULL) -> int:
    return 0 if n & (n - 1) == 0 else full - n


class Packer:
    """Takes documents in order, gives pieces; see the module's text."""

    def __init__(self, first_sequence: int, ends_sentence: np.ndarray, full: int = FULL):
        self.sequence, self.ends, self.full = first_sequence, ends_sentence, full
        self.docs: list[list] = []  # [doc_id, tokens, start of what is left, ids left]
        self.size = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append([doc_id, len(ids), 0, ids])
        self.size += len(ids)
        if self.size >= STRETCH * self.full:
            yield from self.solve(False)

    def solve(self, last: bool):
        if not self.size:
            return
        ids = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        at, penalty = candidates(len(ids), ends, np.flatnonzero(self.ends[ids]) + 1, self.full)
        cost, back = best_cuts(at, penalty, self.full)
        at, penalty = at.tolist(), penalty.tolist()
        j = len(at) - 1
        if not last:
            tail = range(int(np.searchsorted(at, len(ids) - self.full)), len(at))
            j = min(tail, key=lambda k: (cost[k] - penalty[k], k))
        cuts = [at[j]]
        while j:
            j = back[j]
            cuts.append(at[j])
        cuts.reverse()
        if last:
            cuts = self._split_tail(cuts)
        else:
            settled = [c for c in cuts if c <= len(ids) - SETTLED * self.full]
            cuts = settled if len(settled) > 1 else cuts[:2]
        yield from self._emit(cuts, ids)

    def _split_tail(self, cuts: list[int]) -> list[int]:
        """A last window that would be padded may be cut freely into powers of two, if those cuts cost less."""
        a, b = cuts[-2:]
        n = b - a
        if padding(n, self.full) <= (bin(n).count("1") - 1) * (INSIDE + PER_WINDOW):
            return cuts
        bits = [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]
        return cuts[:-1] + (a + np.cumsum(bits)).tolist()

    def _emit(self, cuts: list[int], ids: np.ndarray):
        """Pieces of the windows between cuts; what lies beyond the last cut stays."""
        k, base = 0, 0  # the document and where its rest begins in ids
        for a, b in zip(cuts, cuts[1:]):
            pos = a
            while pos < b:
                doc = self.docs[k]
                stop = min(b, base + len(doc[3]))
                part = ids[pos:stop]
                yield doc[0], doc[2] + pos - base, stop - pos, zlib.crc32(part.tobytes()), doc[1], self.sequence, pos - a
                if stop == base + len(doc[3]):
                    base, k = stop, k + 1
                pos = stop
            self.sequence += 1
        kept = self.docs[k:]
        if kept and cuts[-1] > base:
            kept[0] = [kept[0][0], kept[0][1], kept[0][2] + cuts[-1] - base, kept[0][3][cuts[-1] - base :]]
        self.docs, self.size = kept, len(ids) - cuts[-1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_enders(tok) -> np.ndarray:
    """By id, whether a token's text ends a sentence."""
    flags = np.zeros(max(tok.get_vocab_size(), 3), dtype=bool)
    for piece, k in tok.get_vocab().items():
        flags[k] = piece.removesuffix("</w>")[-1:] in (".", "!", "?", "…") and piece.endswith("</w>")
    return flags


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, full: int = FULL, partitions: int | None = None) -> DataFrame:
    """Pieces of every document's ids (its text's, then end_id), dealt to sequences.

    Each id lies in one piece. A null or empty text has the one id end_id. Documents with null or equal ids are packed each for
    itself, nulls first and equal ids by text, and may be dealt to several tasks. Other columns aren't read, whatever
    they are called. An empty table gives no pieces.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    n = partitions or shuffle_partitions(docs.sparkSession)

    def run(batches):
        own = codec(path)
        end = np.uint32(end_id)
        packer, rows = Packer(TaskContext.get().partitionId() << 40, sentence_enders(own.tok), full), []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, counts, tokens in own.groups(batch):
                b = 0
                for k, n in enumerate(counts.tolist()):
                    a, b = b, b + n
                    rows += packer.add(ids[first + k], np.append(tokens[a:b], end))
            if len(rows) >= 5000:
                yield _batch(rows)
                rows = []
        rows += packer.solve(True)
        if rows:
            yield _batch(rows)

    return in_id_order(docs, id_col, text_col, n).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in SCHEMA.split(", ")])


def op10_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
