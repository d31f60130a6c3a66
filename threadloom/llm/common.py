"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line contracts: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
_own_shared: str | None = None


#: Caches of this Python worker that are worth keeping from task to task of one operator, but not into the next one's.
CACHES: list[dict] = []


def trim(keep: bool = False) -> None:
    """Give the memory of earlier tasks in this worker back to the system; `keep` leaves its caches."""
    if not keep:
        for cache in CACHES:
            cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one if all runs on this machine (tests), else an error."""
    global _own_shared
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_shared = _own_shared or tempfile.mkdtemp(prefix="threadloom-")
        root = f"file://{_own_shared}"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this name below the shared one."""
    return f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder as Parquet: lineage ends there, so a lost executor costs a reread only."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for these tables, of which nothing is read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_id_order(docs: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """(doc_id, text) of docs in ascending id order over `partitions` ranges, nulls first, equal ids by text.

    Ranges are of the id and the text's first 32 characters, so rows that share an id, or have none, are spread too; the bounds,
    which the driver samples, stay short.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.repartitionByRange(partitions, "doc_id", F.left("text", F.lit(32))).sortWithinPartitions("doc_id", "text")


def fold(doc_id, mod: int = 5):
    """crc32 of the id as text, modulo mod; a null id is in fold 0, as the empty text would be."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_groups(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch, in groups of about `limit` characters; null texts are empty. Only one group is decoded at a time."""
    col = batch.column(batch.schema.get_field_index(column))
    start, size, group = 0, 0, []
    for i in range(len(col)):
        text = col[i].as_py() or ""
        group.append(text)
        size += len(text)
        if size >= limit:
            yield start, group
            start, size, group = i + 1, 0, []
    if group:
        yield start, group


def local_files(path: str):
    """(filesystem, path) of pyarrow for a folder named by URI."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = f"file://{os.path.abspath(path)}"
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(path)
