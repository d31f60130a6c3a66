"""JSONL transcripts: <root>/<project>/**/*.jsonl, one JSON object a line.

Files are listed and read by Spark, so any store that it can read will do. Lines are parsed in Arrow batches by Python's JSON
reader, as `content` is text or an array of blocks that nest to any depth.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.kinds import kind_of, strip
from threadloom.functions.words import session_id_of
from threadloom.schema import content_hash


def list_files(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """(file_path, file_mtime) of all transcripts, or of one project's; only metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(f"{root}/{project}" if project else root)
    return files.select(F.col("path").alias("file_path"), (F.unix_micros("modificationTime") / 1e6).alias("file_mtime"))


def read_lines(spark: SparkSession, root: str, project: str | None = None, only: list[str] | None = None) -> DataFrame:
    """(project_slug, session_id, file_path, file_mtime, pos, line) of all lines that aren't blank, or of the files `only`; files are read whole, as order within them matters."""
    if only == []:
        return spark.createDataFrame([], "project_slug string, session_id string, file_path string, file_mtime double, pos int, line string")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(only or (f"{root}/{project}" if project else root), wholetext=True)
    base = root.rstrip("/").removeprefix("file://")
    rows = raw.select(F.col("_metadata.file_path").alias("file_path"), (F.unix_micros("_metadata.file_modification_time") / 1e6).alias("file_mtime"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "line"))
    relative = F.substring_index(F.col("file_path"), base + "/", -1)
    slug = F.substring_index(relative, "/", 1)
    rows = rows.where(strip(F.col("line")) != "")
    return rows.select(slug.alias("project_slug"), session_id_of(F.expr("substring(file_path, instr(file_path, '" + base.replace("'", "\\'") + "/') + " + str(len(base) + 1) + ")").substr(F.length(slug) + 2, F.lit(1 << 30))).alias("session_id"), "file_path", "file_mtime", "pos", F.col("line"))


def flatten(content, tool_blocks: bool = False) -> str:
    """Text of a content: itself, or that of its blocks, line by line; blocks of tools only on demand, results of tools at any depth. What isn't a block says nothing."""
    if isinstance(content, str):
        return content
    if not isinstance(content, list):
        return "" if content is None else str(content)
    return "\n".join(x for x in (_block_text(b, tool_blocks) for b in content if isinstance(b, dict)) if x is not None)


def _block_text(block: dict, tool_blocks: bool) -> str | None:
    """A block's text; None if it has none to show."""
    kind, inside = block.get("type"), block.get("content")
    if kind == "text":
        text = block.get("text")
        return text if isinstance(text, str) and text else None
    if kind == "tool_use" and tool_blocks:
        return f"[tool_use: {block.get('name', '')}] {json.dumps(block.get('input', {}))}"
    if kind == "tool_result" and tool_blocks and isinstance(inside, (str, list)):
        return f"[tool_result] {flatten(inside, True)}"
    return None


def parse_line(line: str, tool_blocks: bool = False) -> tuple[str, str, str | None] | None | bool:
    """(role, content, timestamp); None for a line that says nothing; False for one that isn't JSON."""
    try:
        v = json.loads(line)
    except ValueError:
        return False
    if not isinstance(v, dict):
        return None
    m = v.get("message") if isinstance(v.get("message"), dict) else {}
    text = lambda *xs: next((x for x in xs if isinstance(x, str) and x), None)
    content = flatten(m["content"] if "content" in m else v.get("content"), tool_blocks)
    if not content.strip():
        return None
    return text(m.get("role"), v.get("role"), v.get("type")) or "unknown", content, text(v.get("timestamp"), m.get("timestamp"))


def parse_lines(lines: DataFrame, tool_blocks: bool = False) -> DataFrame:
    """lines with role, content, timestamp (null where there is no message) and malformed."""

    @F.pandas_udf("struct<role:string,content:string,timestamp:string,malformed:boolean>")
    def parsed(line: pd.Series) -> pd.DataFrame:
        got = [parse_line(x, tool_blocks) for x in line]
        return pd.DataFrame([(*x, False) if x else (None, None, None, x is False) for x in got], columns=["role", "content", "timestamp", "malformed"])

    return lines.withColumn("m", parsed("line")).select("*", "m.*").drop("m", "line")


def read_archive(spark: SparkSession, root: str, project: str | None = None, tool_blocks: bool = False, now: str | None = None, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of the transcripts, messages with msg_id still null. A session's times are its first and last, in the file's order, of messages that have one."""
    rows = parse_lines(read_lines(spark, root, project, only), tool_blocks)
    some = rows.where("content is not null")
    order = Window.partitionBy("session_id", "file_path").orderBy("pos")
    messages = some.select(F.lit(None).cast("long").alias("msg_id"), "session_id", "role", "content", (F.row_number().over(order) - 1).cast("int").alias("turn_index"), "timestamp", content_hash(F.col("content")).alias("content_hash"), kind_of(F.col("content"), F.col("role")).alias("content_kind"))
    timed = F.col("content").isNotNull() & F.col("timestamp").isNotNull()
    sessions = rows.groupBy("session_id", "project_slug", "file_path", "file_mtime").agg(F.min_by("timestamp", F.when(timed, F.col("pos"))).alias("started_at"), F.max_by("timestamp", F.when(timed, F.col("pos"))).alias("ended_at"), F.count("content").cast("int").alias("turn_count"), F.count_if("malformed").alias("malformed"))
    return sessions.withColumn("indexed_at", F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")), messages
