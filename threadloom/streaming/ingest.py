"""Transcripts as a stream: new files are parsed and upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.archive import parse_lines


def watch(spark: SparkSession, root: str, checkpoint: str, upsert: Callable[[DataFrame, int], None], tool_blocks: bool = False):
    """Start a query that hands each batch's parsed lines (file_path, pos, role, content, timestamp, malformed) to upsert and ends when all files present have been seen.

    The file source follows new files; files that grow need the listing of sources.archive. Upserts are by session and turn, so
    that a batch that runs again changes nothing.
    """
    lines = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    rows = lines.select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "line")).where("trim(line) <> ''")
    return parse_lines(rows, tool_blocks).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(upsert).start()
