"""Listings, lookups and health of an archive."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READY = 0.95


def list_sessions(sessions: DataFrame, messages: DataFrame, limit: int = 20, project: str | None = None) -> DataFrame:
    """Newest sessions (null starts last) with their first user message. Equal starts are ordered by id."""
    s = sessions if project is None else sessions.where(F.lower("project_slug") == project.lower())
    first = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "turn_index").alias("first_user"))
    newest = s.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(limit)
    return newest.join(first, "session_id", "left").orderBy(F.desc_nulls_last("started_at"), "session_id")


def find_session(sessions: DataFrame, key: str) -> DataFrame:
    """The session of this id; else the only one whose id begins so (ASCII case apart). No row, or ValueError naming up to ten, if there is no single one."""
    exact = sessions.where(F.col("session_id") == key)
    if not exact.isEmpty():
        return exact
    close = sessions.where(F.lower("session_id").startswith(key.lower()))
    some = close.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(10).select("session_id").collect()
    if len(some) > 1:
        raise ValueError(f"{key!r} is ambiguous: " + ", ".join(r.session_id for r in some))
    return close


def turn_range(spec: str | None, total: int) -> tuple[int, int]:
    """Half-open range of list places: a-b, -n (the last n), n; all for anything else."""
    if spec and (m := re.fullmatch(r"(\d+)-(\d+)", spec.strip())):
        return int(m[1]), min(total, int(m[2]) + 1)
    if spec and (m := re.fullmatch(r"-(\d+)", spec.strip())):
        return max(0, total - int(m[1])), total
    if spec and spec.strip().isdigit():
        return int(spec), min(total, int(spec) + 1)
    return 0, total


def show_turns(messages: DataFrame, session_id: str, lo: int = 0, hi: int | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index")) - 1
    rows = messages.where(F.col("session_id") == session_id).withColumn("place", place).where(F.col("place") >= lo)
    return (rows if hi is None else rows.where(F.col("place") < hi)).drop("place").orderBy("turn_index")


def turn_gaps(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions whose turn_count differs from the messages there are, the largest difference first."""
    found = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("actual"))
    both = sessions.select("session_id", "project_slug", "turn_count").join(found, "session_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.where("turn_count <> actual").orderBy(F.desc(F.abs(F.col("turn_count") - F.col("actual"))), "session_id")


def project_totals(sessions: DataFrame, messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per project: sessions, claimed turns, messages, vectors. Counted per session first, so that joins don't multiply."""
    of_session = messages.select("session_id", "msg_id").join(vectors.select("msg_id", F.lit(1).alias("has")), "msg_id", "left").groupBy("session_id").agg(F.count(F.lit(1)).alias("m"), F.count("has").alias("v"))
    rows = sessions.select("session_id", "project_slug", "turn_count").join(of_session, "session_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("project_slug").agg(F.count(F.lit(1)).alias("n_sessions"), total("turn_count").alias("turns"), total("m").alias("n_messages"), total("v").alias("n_vectors"))


def orphan_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return messages.join(sessions, "session_id", "left_anti")


def missing_from_index(messages: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """Messages that the inverted index doesn't hold."""
    return messages.select("msg_id").join(doc_stats, "msg_id", "left_anti")


def unembedded(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    return messages.join(vectors, "msg_id", "left_anti").orderBy("msg_id")


def coverage(n_vectors: Column, n_messages: Column) -> Column:
    return F.round(F.when(n_messages > 0, n_vectors / n_messages).otherwise(1.0), 4)


def status(sessions: DataFrame, messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts, newest times, vector coverage and whether that is enough for semantic search."""
    s = sessions.agg(F.count(F.lit(1)).alias("n_sessions"), F.max("ended_at").alias("last_message_at"), F.max("indexed_at").alias("last_indexed_at"))
    m = messages.agg(F.count(F.lit(1)).alias("n_messages"))
    v = vectors.agg(F.count(F.lit(1)).alias("n_vectors"))
    share = coverage(F.col("n_vectors"), F.col("n_messages"))
    return s.crossJoin(m).crossJoin(v).withColumn("coverage", share).withColumn("semantic_ready", F.col("coverage") >= READY)


def resolve_project(sessions: DataFrame, slug: str) -> str:
    """The stored spelling of a slug, found without case; the slug itself if there is none."""
    r = sessions.where(F.lower("project_slug") == slug.lower()).agg(F.min("project_slug")).first()[0]
    return r or slug


def reclassified(messages: DataFrame) -> DataFrame:
    """(msg_id, old_kind, new_kind) of messages whose kind isn't what the rules say now."""
    from threadloom.functions.kinds import kind_of

    rows = messages.select("msg_id", F.col("content_kind").alias("old_kind"), kind_of(F.col("content"), F.col("role")).alias("new_kind"))
    return rows.where(~F.col("old_kind").eqNullSafe(F.col("new_kind")))


def kind_changes(messages: DataFrame) -> DataFrame:
    """Per kind: messages before (none counts as THOUGHT) and after reclassification."""
    from threadloom.functions.kinds import THOUGHT, kind_of

    pair = messages.select(F.array(F.struct(F.coalesce("content_kind", F.lit(THOUGHT)).alias("kind"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(kind_of(F.col("content"), F.col("role")).alias("kind"), F.lit(0).alias("b"), F.lit(1).alias("a"))).alias("x"))
    return pair.select(F.inline("x")).groupBy("kind").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
