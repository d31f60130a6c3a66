"""Benchmark decontamination by latent semantic retrieval.

Passages (tiles of TILE words) and benchmark items are TF-IDF vectors over the items' own terms, with document frequencies counted
over all passages of the corpus. A randomised SVD of the passages, distributed as one sum of sketches (Halko, Martinsson and
Tropp, 2011; the one-pass form for A'A), gives the latent space; the items' vectors take part in it with the corpus's weight, so
that the space holds their directions. Windows of two neighbouring tiles, at steps of one, are candidates of an item if their latent
cosine reaches `cosine`. A candidate is confirmed in the document's words: the longest common subsequence of item and window
with its surroundings has to cover enough of the item, within a span that isn't much longer, and if it covers less than NEAR of
it, enough of the item's answer (the rare words of its last sentence of three or more words) has to be there. Changed, dropped or
inserted words therefore don't hide a passage. All terms count, however common; the most common ones only take another way
through the arithmetic (dense columns).

Only what depends on the benchmark is broadcast: its terms, vectors and words. Blocks of items are closed by their number and by
their words, which bounds what is broadcast and what a task holds; a larger benchmark is searched block by block.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import table, trim
from threadloom.llm.wordcodec import text_bytes

TILE = 24
RANK = 256
COSINE = 0.4
COVER = 0.6
ANSWER = 0.5
#: Matches that cover this much of an item are copies, whatever became of the answer.
NEAR = 0.8
STRETCH = 2.0
BLOCK_ITEMS = 2000
BLOCK_WORDS = 30_000
#: Terms in more than this share of passages are dense columns. It decides speed only.
DENSE = 1 / 256
#: Passages that are multiplied at once.
ROWS = 4096
#: Of these, as many meet the terms without dense columns at once. It decides speed only.
BLOCK_ROWS = 64
SEED = 7
SKETCH_TERMS = 64
#: How many tasks' sketches are summed up, level by level.
TREE = (64, 4096, 1 << 40)
#: Lengths of subsequences stand above this many bits of their begins.
CELL_BITS = 32
CELL = 1 << CELL_BITS
SKETCH = "first long, task long, y binary"
#: Bytes of words: A-Z lower-cased, ASCII marks taken for white space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
MARKS = bytes(b for b in range(256) if WORDS[b] == 32)
INSIDE = bytes(WORDS[b] != 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split()


class Items:
    """A block of benchmark items: words, terms, answers."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.words = [words_of(t) for _, t in rows]
        self.terms = {w: k for k, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws))}
        self.coded = [np.array([self.terms[w] for w in ws], np.int32) for ws in self.words]
        self.times = [list(Counter(c.tolist()).items()) for c in self.coded]
        last = [[s for s in re.split(r"(?<=[.!?…])\s+|\n+", t.strip()) if len(words_of(s)) > 2] or [t] for _, t in rows]
        self.tails = [np.array([self.terms[w] for w in words_of(s[-1])], np.int32) for s in last]


class Coded:
    """Texts as numbers of their words: the item term, or -1 for words of no item."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, terms: pa.Array):
        raw = data.tobytes()
        inside = np.frombuffer(raw.translate(INSIDE), bool)
        first, last = inside.copy(), inside.copy()
        first[1:] = inside[1:] > inside[:-1]
        last[:-1] = inside[:-1] > inside[1:]
        begins = ends[:-1][np.diff(ends, prepend=0)[1:] > 0]
        first[begins], last[begins - 1] = inside[begins], inside[begins - 1]
        start = np.flatnonzero(first)
        at = np.zeros(len(start) + 1, np.int32)
        np.cumsum(np.flatnonzero(last) + 1 - start, out=at[1:])
        array = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw.translate(WORDS, MARKS))])
        self.words = np.asarray(pc.index_in(array, value_set=terms).fill_null(-1))
        self.ends = np.searchsorted(start, ends)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        #: Each text has its tiles and then an empty one; `base` is its first.
        self.n_tiles = -(-(self.ends - self.starts) // TILE) + 1
        self.base = np.cumsum(self.n_tiles) - self.n_tiles

    def of(self, k: int) -> np.ndarray:
        return self.words[self.starts[k] : self.ends[k]]

    def tiles(self, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tile, term, times) of all terms in tiles, by tile and term."""
        at = np.flatnonzero(self.words >= 0)
        text = np.searchsorted(self.ends, at, "right")
        key, times = np.unique(((at - self.starts[text]) // TILE + self.base[text]) * n_terms + self.words[at], return_counts=True)
        return key // n_terms, key % n_terms, times


def lcs_length(item: list[int], words: list[int]) -> int:
    """Length of a longest common subsequence, by bit-parallel rows (Hyyro, 2004): a row is one integer."""
    places: dict[int, int] = {}
    bit = 1
    for w in words:
        places[w] = places.get(w, 0) | bit
        bit <<= 1
    full = bit - 1
    row = full
    for t in item:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(words) - row.bit_count()


def lcs_span(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Length of a longest common subsequence, and where in words it begins and ends (the shortest end-first choice)."""
    n = len(words)
    # a cell is its length and, in the low bits, its begin
    cells, column = np.arange(n + 1), np.arange(n + 1)
    for t in item.tolist():
        before = (words == t).nonzero()[0]
        if not len(before):
            continue
        # candidates that take a match, with the row above; then the best so far from the left
        grown, at = cells[before] + CELL, before + 1
        cells[at] = np.maximum(cells[at], grown)
        length = cells >> CELL_BITS
        src = np.maximum.accumulate(np.where(length == np.maximum.accumulate(length), column, 0))
        cells = cells[src]
    length = cells >> CELL_BITS
    best = int(length[-1])
    end = int(np.searchsorted(length, best))
    return best, int(cells[end] & (CELL - 1)), end


class Weights:
    """Weights of terms, and products of weighted passages with matrices that have a row a term. `dense` are the terms that have columns."""

    def __init__(self, idf: np.ndarray, dense: np.ndarray):
        self.idf, self.dense = idf, np.flatnonzero(dense)
        self.column = np.full(len(idf), -1)
        self.column[self.dense] = np.arange(len(self.dense))

    def of(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, n_rows: int, unit: bool):
        """(columns of the dense terms, blocks of the others) of n_rows passages; rows in order. unit: each row of length 1.

        A block is its first row, a matrix of BLOCK_ROWS rows by the terms that occur in them, and these terms.
        """
        w = (1 + np.log(times)) * self.idf[term]
        if unit:
            w /= np.sqrt(np.bincount(row, w * w, n_rows))[row]
        w = w.astype(np.float32)
        column = self.column[term]
        there = column >= 0
        x = np.zeros((n_rows, len(self.dense)), np.float32)
        x[row[there], column[there]] = w[there]
        return x, self._blocks(row[~there], term[~there], w[~there], n_rows)

    def _blocks(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, n_rows: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        first = np.arange(0, n_rows, BLOCK_ROWS)
        block, n_terms = row // BLOCK_ROWS, len(self.idf)
        key, at = np.unique(block * n_terms + term, return_inverse=True)
        cut = np.searchsorted(key, np.arange(len(first) + 1) * n_terms)
        width, height = np.diff(cut), np.minimum(BLOCK_ROWS, n_rows - first)
        size = np.concatenate([[0], np.cumsum(width * height)])
        y = np.zeros(size[-1], np.float32)
        y[size[block] + (row - first[block]) * width[block] + at - cut[block]] = w
        key %= n_terms
        return [(int(first[b]), y[size[b] : size[b + 1]].reshape(height[b], width[b]), key[cut[b] : cut[b + 1]]) for b in np.flatnonzero(width)]

    def times(self, parts, matrix: np.ndarray) -> np.ndarray:
        x, blocks = parts
        out = x @ matrix[self.dense]
        for first, y, terms in blocks:
            out[first : first + len(y)] += y @ matrix[terms]
        return out

    def add_back(self, parts, image: np.ndarray, total: np.ndarray) -> None:
        """total += the passages, transposed, times their image."""
        x, blocks = parts
        total[self.dense] += x.T @ image
        for first, y, terms in blocks:
            total[terms] += y.T @ image[first : first + len(y)]


class Space:
    """Weights of terms and the latent space."""

    def __init__(self, weights: Weights, basis: np.ndarray):
        self.weights, self.basis = weights, basis

    def vectors(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, n_rows: int) -> np.ndarray:
        return self.weights.times(self.weights.of(row, term, times, n_rows, False), self.basis)


def _stretches(row: np.ndarray, n_rows: int):
    """(first passage, how many, slice of the rows) of stretches of ROWS passages."""
    for first in range(0, n_rows, ROWS):
        n = min(ROWS, n_rows - first)
        yield first, n, slice(*np.searchsorted(row, [first, first + n]))


def _item_rows(items: Items):
    row = np.concatenate([np.full(len(c), k) for k, c in enumerate(items.coded)]) if items.coded else np.empty(0, np.int64)
    key, times = np.unique(row * len(items.terms) + np.concatenate(items.coded), return_counts=True)
    return key // len(items.terms), key % len(items.terms), times


def fit_space(docs: DataFrame, items: Items, rank: int = RANK) -> Space:
    """Document frequencies and latent space over all passages of docs (column text). Two passes; per task one array of counts and one sketch of (terms, rank) numbers."""
    spark, n_terms = docs.sparkSession, len(items.terms)
    names = pa.array(list(items.terms), pa.binary())
    shared = spark.sparkContext.broadcast(names)

    def frequencies(batches):
        trim()
        df, n = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            for _, data, ends in text_bytes(batch.column(0)):
                coded = Coded(data, ends, shared.value)
                df += np.bincount(coded.tiles(n_terms)[1], minlength=n_terms)
                n += int(coded.n_tiles.sum()) - len(ends)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), n_terms]), pa.array([*df[at].tolist(), n])], ["term", "n"])

    df = np.zeros(n_terms + 1)
    for r in docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    total, df = max(df[-1], 1), df[:-1]
    weights = Weights(np.log((total + 1) / (df + 1)) + 1e-3, df > DENSE * total)
    rank = max(1, min(rank, n_terms))
    omega = np.random.default_rng(SEED).normal(size=(n_terms, rank)).astype(np.float32)
    given = spark.sparkContext.broadcast((names, weights, omega))

    def sketch(batches):
        trim()
        names, weights, omega = given.value
        total = np.zeros(omega.shape)
        for batch in batches:
            for _, data, ends in text_bytes(batch.column(0)):
                coded = Coded(data, ends, names)
                row, term, times = coded.tiles(n_terms)
                for first, n, part in _stretches(row, int(coded.n_tiles.sum())):
                    parts = weights.of(row[part] - first, term[part], times[part], n, True)
                    weights.add_back(parts, weights.times(parts, omega), total)
        for k in range(0, n_terms, SKETCH_TERMS):
            part = total[k : k + SKETCH_TERMS].astype("<f4")
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([TaskContext.get().partitionId()]), pa.array([part.tobytes()], pa.binary())], ["first", "task", "y"])

    def added(table):
        total = 0.0
        for y in table.column("y"):
            total = total + np.frombuffer(y.as_py(), "<f4").astype(np.float64)
        return pa.table({"first": table.column("first").slice(0, 1), "task": table.column("task").slice(0, 1), "y": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    y = np.zeros((n_terms, rank))
    sums = docs.select("text").mapInArrow(sketch, SKETCH)
    for tasks in TREE:
        # sums over neighbouring tasks: no task reads very many sketches of a stretch of terms
        sums = sums.select("first", (F.col("task") / tasks).cast("long").alias("task"), "y").groupBy("first", "task").applyInArrow(added, SKETCH)
        sums = sums.withColumn("task", F.col("task") * tasks)
    for r in sums.collect():
        part = np.frombuffer(r.y, "<f4").reshape(-1, rank)
        y[r["first"] : r["first"] + len(part)] = part
    own = np.zeros_like(y)
    parts = weights.of(*_item_rows(items), len(items.coded), True)
    weights.add_back(parts, weights.times(parts, omega), own)
    return Space(weights, _basis(y + own * max(1.0, total / len(items.coded)), omega.astype(np.float64)))


def _basis(y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Right singular vectors of A from Y = A'A omega: the one-pass approximation A'A = Y (omega'Y)^-1 Y'."""
    shift = 1e-7 * max(np.linalg.norm(y), 1e-9)
    y = y + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(), 1e-12) * 1e-10
    b = y @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    return u[:, s > s.max() * 1e-6 if len(s) else []].astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


MATCH = "doc_id long, item_id long, cosine double, lcs int, n_words int, begin int, end int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rank: int = RANK, cosine: float = COSINE, cover: float = COVER, answer: float = ANSWER, block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, n_words, begin, end) of each document that holds an item, once per pair: the match with the longest common subsequence, then the highest cosine; begin and end are places of words.

    n_words is the item's length in words (maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased). Items and
    documents that are null or without words match nothing; a document without an id can match, and its rows count as one
    document, as do repeated rows with one id. Only id_col and text_col are read, whatever other columns are called. Items are
    searched in blocks of at most block_items items and block_words words (or one longer item), which bounds what is broadcast
    and what a task holds; each block reads docs three times. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = benchmark.select(F.col(item_id).cast("long"), item_text).where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).distinct().orderBy(item_id, item_text)
    out = None
    block: list[tuple[int, str]] = []
    size = 0

    def searched(block):
        part = _search(rows, Items(block), rank, cosine, cover, answer)
        return part if out is None else out.unionByName(part)

    for r in every.toLocalIterator():
        n = len(words_of(r[1]))
        if block and n and (len(block) == block_items or size + n > block_words):
            out, block, size = searched(block), [], 0
        if n:
            block.append((r[0], r[1]))
            size += n
    if block:
        out = searched(block)
    if out is None:
        return spark.createDataFrame([], MATCH)
    best = F.max_by(F.struct("cosine", "lcs", "n_words", "begin", "end"), F.struct("lcs", "cosine", F.negate("begin")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.*")


def _search(rows: DataFrame, items: Items, rank: int, cosine: float, cover: float, answer: float) -> DataFrame:
    space = fit_space(rows, items, rank)
    given = rows.sparkSession.sparkContext.broadcast((items, space))

    def run(batches):
        trim()
        items, space = given.value
        n_terms, names = len(items.terms), pa.array(list(items.terms), pa.binary())
        latent = _unit(space.vectors(*_item_rows(items), len(items.coded))).T.copy()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, ends in text_bytes(batch.column(1)):
                coded, found = Coded(data, ends, names), []
                row, term, times = coded.tiles(n_terms)
                n_rows = int(coded.n_tiles.sum())
                gap = np.zeros(n_rows + 1, bool)
                gap[coded.base + coded.n_tiles - 1] = True
                held = np.zeros((1, space.basis.shape[1]), np.float32)
                # from the end, as a window is a tile and the next one, or the last tile by itself
                for a, n, part in reversed(list(_stretches(row, n_rows))):
                    v = space.vectors(row[part] - a, term[part], times[part], n)
                    window = v + np.concatenate([v[1:], held])
                    held = v[:1]
                    window[gap[a : a + n]] = 0
                    close = _unit(window) @ latent
                    hits = np.flatnonzero(close >= cosine)
                    for i, j, x in zip((hits // close.shape[1] + a).tolist(), (hits % close.shape[1]).tolist(), close.ravel()[hits].tolist()):
                        d = int(np.searchsorted(coded.base, i, "right")) - 1
                        found.append((first + d, d, i - int(coded.base[d]), j, x))
                # neighbouring windows of one item are one candidate
                for cand in _merged(found):
                    m = _confirm(items, space.weights.idf, coded.of(cand[1]), cand, cover, answer)
                    if m:
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[cand[0]]], pa.int64()), "item_id": pa.array([items.ids[cand[3]]], pa.int64()), "cosine": [cand[4]], "lcs": pa.array([m[0]], pa.int32()), "n_words": pa.array([len(items.coded[cand[3]])], pa.int32()), "begin": pa.array([m[1]], pa.int32()), "end": pa.array([m[2]], pa.int32())})

    return rows.mapInArrow(run, MATCH)


def _merged(found: list[tuple]) -> list[tuple]:
    """Of runs of neighbouring windows of one text and item one candidate, the closest, with the first and last tile of the run."""
    out: list[list] = []
    for row, d, tile, item, cos in sorted(found, key=lambda f: (f[0], f[3], f[2])):
        if out and out[-1][0] == row and out[-1][3] == item and tile <= out[-1][5] + 2:
            out[-1][5] = tile
            out[-1][4] = max(out[-1][4], cos)
        else:
            out.append([row, d, tile, item, cos, tile])
    return [tuple(x) for x in out]


def _confirm(items: Items, weight: np.ndarray, words: np.ndarray, cand: tuple, cover: float, answer: float):
    item = items.coded[cand[3]]
    margin = len(item)
    # in steps, as a run of windows can be as long as a text
    best = None
    for tile in range(cand[2], cand[5] + 1, max(1, margin // TILE)):
        a, b = max(0, tile * TILE - margin), min(len(words), (tile + 2) * TILE + margin)
        part = words[a:b]
        # a subsequence can't be longer than what the two have in common, nor need its place be known if it is too short
        listed = part.tolist()
        seen = set(listed)
        common = sum(n for t, n in items.times[cand[3]] if t in seen)
        if common < cover * len(item) or lcs_length(item.tolist(), listed) < cover * len(item):
            continue
        n, begin, end = lcs_span(item, part)
        if n >= cover * len(item) and end - begin <= STRETCH * len(item) and (best is None or n > best[0]):
            if n >= NEAR * len(item):
                best = (n, a + begin, a + end)
                continue
            there = set(words[a + begin : a + end + len(item) // 4].tolist())
            tail = np.unique(items.tails[cand[3]])
            value = weight[tail] + 1e-9
            if value[[t in there for t in tail.tolist()]].sum() >= answer * value.sum():
                best = (n, a + begin, a + end)
    return best


def op2_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
