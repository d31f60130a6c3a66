"""Chunks of documents, and exact corpus-wide counts of their keys by request and reply.

Counting every n-gram of a corpus and looking the counts up again would shuffle each occurrence twice. Here documents are packed
into chunks (rows of some MB of text, compressed, with ids that are fixed once written). A chunk asks for each of its distinct
keys once: sorted 64-bit hashes, split by ranges of the hash, delta-coded. A task that owns a range sums up what all chunks
sent and answers each with the totals, in the order of its request, so that no key travels back. A key that a third of all
documents hold is one entry a chunk; no task depends on how often a key occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, shuffle_partitions, trim

CHUNK_CHARS = 4 << 20
REPLY = "chunk long, kind int, range int, counts binary, n_keys long, n_total long"
_level = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def zip_ints(a: np.ndarray) -> bytes:
    """Compressed byte planes of unsigned integers: high planes of small numbers cost nothing."""
    return len(a).to_bytes(8, "little") + _level[0].compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unzip_ints(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_level[1].decompress(data[8:]), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def zip_sorted(a: np.ndarray) -> bytes:
    return zip_ints(np.diff(a, prepend=a.dtype.type(0)))


def unzip_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unzip_ints(data), dtype=np.uint64)


def pack_chunks(docs: DataFrame, id_col: str, text_col: str, chars: int = CHUNK_CHARS) -> DataFrame:
    """(chunk, payload): all rows of docs, in rows of about `chars` characters, written to the shared folder. A longer document is a chunk by itself."""

    def run(batches: Iterator[pa.RecordBatch]):
        trim()
        part, k = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def row():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "payload"])

        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32 if pa.types.is_string(batch.column(1).type) else np.int64)[batch.column(1).offset :][: len(batch) + 1]) if len(batch) else []
            start = 0
            for i, n in enumerate(sizes):
                size += int(n)
                if size >= chars:
                    held.append(batch.slice(start, i + 1 - start))
                    yield row()
                    k, held, size, start = k + 1, [], 0, i + 1
            if start < len(batch):
                held.append(batch.slice(start))
        if held:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, "chunk long, payload binary"), "chunks")


def unpack(payload: bytes) -> tuple[list, list[str]]:
    """Ids and texts of a chunk; null texts are empty."""
    table = pa.ipc.open_stream(payload).read_all()
    return table.column(0).to_pylist(), [t or "" for t in table.column(1).to_pylist()]


def splits(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds in sorted keys of each range of the hash space."""
    at = (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges)
    return np.concatenate([[0], np.searchsorted(keys, at << np.uint64(32)), [len(keys)]])


def totals(chunks: DataFrame, request: Callable[[list, list[str]], list[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """The replies: per chunk, kind and range the totals of that chunk's keys. n_keys and n_total, over all rows, sum to the distinct keys and the counts of the kind.

    request(ids, texts) gives (kind, sorted distinct uint64 keys, counts) of a chunk. Keys with count 0 are asked for without being counted.
    """
    # a task sorts one range at a time
    ranges = 2 * shuffle_partitions(chunks.sparkSession)

    def ask(batches):
        trim()
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for kind, keys, counts in request(*unpack(payload.as_py())):
                    at = splits(keys, ranges)
                    for r in range(ranges):
                        a, b = at[r], at[r + 1]
                        if b > a:
                            rows.append((chunk, kind, r, zip_sorted(keys[a:b]), zip_ints(counts[a:b])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["chunk", "kind", "range", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        keys = [unzip_sorted(x.as_py()) for x in table.column("keys")]
        counts = [unzip_ints(x.as_py()) for x in table.column("counts")]
        trim()
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts).astype(np.float64), len(every)).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        n = len(keys)
        zero = [0] * (n - 1)
        return pa.table({"chunk": table.column("chunk"), "kind": table.column("kind"), "range": table.column("range"), "counts": pa.array([zip_ints(total[w]) for w in np.split(where, ends[:-1])], pa.binary()), "n_keys": pa.array([int((total > 0).sum()), *zero], pa.int64()), "n_total": pa.array([int(total.sum()), *zero], pa.int64())})

    asked = chunks.mapInArrow(ask, "chunk long, kind int, range int, keys binary, counts binary")
    return materialize(asked.groupBy("kind", "range").applyInArrow(add, REPLY), "replies")


def with_totals(chunks: DataFrame, replies: DataFrame, use: Callable, schema: str) -> DataFrame:
    """use(chunk, ids, texts, {kind: totals of the chunk's sorted distinct keys}) for each chunk; it yields record batches of the schema."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        payload, parts = None, {}
        for k, r, data in zip(table.column("kind").to_pylist(), table.column("range").to_pylist(), table.column("data")):
            if k < 0:
                payload = data.as_py()
            else:
                parts.setdefault(k, []).append((r, unzip_ints(data.as_py())))
        got = {k: np.concatenate([x for _, x in sorted(v, key=lambda y: y[0])]) for k, v in parts.items()}
        return pa.Table.from_batches(use(table.column("chunk")[0].as_py(), *unpack(payload), got))

    rows = chunks.select("chunk", F.lit(-1).alias("kind"), F.lit(-1).alias("range"), F.col("payload").alias("data"))
    return rows.unionByName(replies.select("chunk", "kind", "range", F.col("counts").alias("data"))).groupBy("chunk").applyInArrow(run, schema)
