"""The archive's tables from Parquet tables of conversations, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.schema import content_hash

#: Prefixes that give short prose the looks of each kind; chosen by (conv_id + turn) mod 5.
PREFIXES = ("", "Let me check ", "<system-reminder> ", 'public static void main(String[] args) { return; } if (a == b) { x[0] = "1"; } for (;;) {} ', "Now Parser:")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time() -> Column:
    when = F.timestamp_add("MINUTE", (F.col("conv_id") * 60 + F.col("turn")).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return F.when(F.col("conv_id") % 11 != 0, F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def messages(spark: SparkSession, sf_dir: str, prefixed: bool = False) -> DataFrame:
    """Conversations as messages, in the archive's columns but content_kind; a twelfth or so without a time."""
    content = F.col("text")
    if prefixed:
        content = F.concat(F.element_at(F.array(*map(F.lit, PREFIXES)), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int")), content)
    rows = read(spark, sf_dir, "conversations").withColumn("content", content)
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.concat(F.lit("conv-"), "conv_id").alias("session_id"), "role", "content", F.col("turn").cast("int").alias("turn_index"), _time().alias("timestamp"), content_hash(F.col("content")).alias("content_hash"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", _time().alias("ts"))
    one = rows.groupBy("conv_id").agg(F.min_by("ts", "turn").alias("started_at"), F.max_by("ts", "turn").alias("ended_at"), F.count(F.lit(1)).cast("int").alias("turn_count"))
    return one.select(F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.concat(F.lit("Proj-"), F.col("conv_id") % 7).alias("project_slug"), F.concat(F.lit("/archive/Proj-"), F.col("conv_id") % 7, F.lit("/conv-"), "conv_id", F.lit(".jsonl")).alias("file_path"), F.col("conv_id").cast("double").alias("file_mtime"), "started_at", "ended_at", "turn_count", F.lit("2024-06-01T00:00:00+00:00").alias("indexed_at"))


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a larger corpus of messages."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), F.col("source").alias("session_id"), F.col("lang").alias("project_slug"), F.col("text").alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("msg_id"), F.col("embedding").alias("vector"), F.lit("given").alias("model"), F.size("embedding").alias("dim"), F.lit("2024-06-01T00:00:00+00:00").alias("embedded_at"), F.col("label").alias("cluster_id"))
