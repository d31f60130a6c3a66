"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths (in tokens) of the corpus's frequent pre-tokens, at most `hot_size` of them and so of
bounded size, which every worker gets by broadcast. Tier two is the worker's own bounded cache, filled by encoding what tier one
misses. No pre-token is a row of a shuffle: to find the frequent ones each task sums up its own texts in one binary summary of at
most `hot_size` pre-tokens, and summaries meet in a tree. The tables decide speed only; counts are the tokenizer's
for any table.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import table
from threadloom.llm.wordcodec import LONG, WordCodec, codec, text_bytes, tokenizer_path

HOT_SIZE = 32_768
#: How many tasks' summaries meet, level by level.
TREE = (32, 1024, 1 << 40)
TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
SUMMARY = "task long, summary binary"


def _packed(counts: Counter, hot_size: int) -> bytes:
    """The hot_size most frequent short pre-tokens with their counts, ties to the smaller."""
    top = sorted(((n, k) for k, n in counts.items() if n > 1 and len(k) <= LONG), key=lambda x: (-x[0], x[1]))[:hot_size]
    return zlib.compress(pickle.dumps([(k, n) for n, k in top]), 1)


def _merged(summaries: list[bytes]) -> Counter:
    total: Counter = Counter()
    for raw in summaries:
        for k, n in pickle.loads(zlib.decompress(raw)):
            total[k] += n
    return total


def frequent_pieces(docs: DataFrame, text: str, path: str, hot_size: int = HOT_SIZE) -> list[bytes]:
    """The most frequent pre-tokens over all texts, most frequent first: at most hot_size byte strings of at most LONG bytes reach the driver, in one summary.

    A task keeps up to 12 hot_size candidates; what it cuts off when it has more, or a summary leaves out, only makes the table less than the best.
    """

    def summary(batches):
        own, counts = codec(path, "count"), Counter()
        for batch in batches:
            for _, data, ends in text_bytes(batch.column(0)):
                plain = own.plain(data, ends)
                units, _ = own.units(*plain)
                n = np.bincount(np.asarray(units.indices), minlength=len(units.dictionary)).tolist()
                for k, x in zip(units.dictionary.to_pylist(), n):
                    counts[k] += x
                if len(counts) > 12 * hot_size:
                    counts = Counter(dict(counts.most_common(4 * hot_size)))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([_packed(counts, hot_size)], pa.binary())], ["task", "summary"])

    def merge(rows: pa.Table) -> pa.Table:
        return pa.table({"task": rows.column("task").slice(0, 1), "summary": pa.array([_packed(_merged(rows.column("summary").to_pylist()), hot_size)], pa.binary())})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(summary, SUMMARY)
    for tasks in TREE:
        # a group is of neighbouring tasks; the last takes what is left
        rows = rows.select((F.col("task") / tasks).cast("long").alias("task"), "summary").groupBy("task").applyInArrow(merge, SUMMARY)
        rows = rows.withColumn("task", F.col("task") * tasks)
    top = _merged([r.summary for r in rows.collect()])
    return [k for k, _ in sorted(top.items(), key=lambda x: (-x[1], x[0]))[:hot_size]]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = TOKEN_LIMIT, hot_size: int = HOT_SIZE) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of docs.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows, null ids and equal ids are counted row by row. Other columns
    of docs are not read, whatever their names. An empty table gives an empty result.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    hot = frequent_pieces(docs, text_col, path, hot_size)
    lengths = [len(ids) for ids in WordCodec(path, "count").learn(hot)]
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, hot, array("I", lengths)))

    def count(batches):
        mine = codec(path, "count")
        key, names, lengths = shared.value
        if mine.seeded != key:
            mine.seed(dict(zip(names, lengths)), key)
        for batch in batches:
            n = [np.empty(0, np.int64), *(x for _, x, _ in mine.groups(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(n), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return read.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
