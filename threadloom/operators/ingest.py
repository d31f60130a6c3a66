"""Incremental upkeep of an archive's tables.

Changes are found by a positional comparison of hashes; unchanged turns keep their ids, and with them their vectors. Results are
new DataFrames; store() swaps them in per project partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, DELETE, INSERT, REPLACE = "KEEP", "DELETE", "INSERT", "REPLACE"


def changed_files(listing: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files (file_path, file_mtime) that no session has with this very time."""
    return listing.join(sessions.select("file_path", "file_mtime"), ["file_path", "file_mtime"], "left_anti")


def turn_actions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(session_id, turn_index, msg_id, action) by a full outer join on the turn; a turn of another hash is REPLACE: its id goes, a new one comes."""
    o = old.select("session_id", "turn_index", "msg_id", F.col("content_hash").alias("old_hash"))
    n = new.select("session_id", "turn_index", F.col("content_hash").alias("new_hash"), F.lit(True).alias("there"))
    both = o.join(n, ["session_id", "turn_index"], "full_outer")
    action = F.when(F.col("there").isNull(), DELETE).when(F.col("msg_id").isNull(), INSERT).when(F.col("old_hash").eqNullSafe(F.col("new_hash")), KEEP).otherwise(REPLACE)
    return both.select("session_id", "turn_index", "msg_id", action.alias("action"))


def upsert_messages(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all messages after the update, ids that are gone). Only sessions in `new` are touched. A kept turn is the stored row, even if its role or time differ now."""
    touched = new.select("session_id").distinct()
    mine, rest = old.join(touched, "session_id", "left_semi"), old.join(touched, "session_id", "left_anti")
    act = turn_actions(mine, new)
    kept = mine.join(act.where(F.col("action") == KEEP).select("msg_id"), "msg_id", "left_semi")
    gone = act.where(F.col("action").isin(DELETE, REPLACE)).select("msg_id")
    fresh = new.join(act.where(F.col("action").isin(INSERT, REPLACE)).select("session_id", "turn_index"), ["session_id", "turn_index"], "left_semi")
    return rest.unionByName(kept).unionByName(number_messages(fresh, old).select(*old.columns)), gone


def number_messages(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """Ids above all of old's, in the order of session and turn: each session gets a range by a running sum over sessions, its turns follow."""
    counts = fresh.groupBy("session_id").agg(F.count(F.lit(1)).alias("__n"))
    # one row a session; the sum over sessions is the only step in one order
    before = F.coalesce(F.sum("__n").over(Window.orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = old.agg(F.coalesce(F.max("msg_id"), F.lit(0)).alias("__top"))
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index"))
    base = counts.select("session_id", before.alias("__before"))
    return fresh.drop("msg_id").join(base, "session_id").crossJoin(F.broadcast(top)).withColumn("msg_id", F.col("__top") + F.col("__before") + turn).drop("__top", "__before")


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known sessions keep their start; file time, end, turns and time of indexing are the new ones."""
    start = old.select("session_id", F.col("started_at").alias("__start"), F.lit(True).alias("__known"))
    merged = new.join(start, "session_id", "left").withColumn("started_at", F.when(F.col("__known"), F.col("__start")).otherwise(F.col("started_at")))
    return old.join(new, "session_id", "left_anti").unionByName(merged.select(*old.columns))


def surviving_vectors(vectors: DataFrame, messages: DataFrame) -> DataFrame:
    """Vectors of messages that still exist."""
    return vectors.join(messages.select("msg_id"), "msg_id", "left_semi")


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """One vector a message, the newest."""
    last = Window.partitionBy("msg_id").orderBy(F.desc("embedded_at"))
    fresh = new.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k")
    return old.join(fresh.select("msg_id"), "msg_id", "left_anti").unionByName(fresh.select(*old.columns))


def delete_vectors(vectors: DataFrame, messages: DataFrame, sessions: DataFrame, project: str | None = None) -> DataFrame:
    """What is left without the vectors of a project (compared without case), or without any."""
    if project is None:
        return vectors.limit(0)
    scope = messages.join(sessions.where(F.lower("project_slug") == project.lower()), "session_id", "left_semi")
    return vectors.join(scope.select("msg_id"), "msg_id", "left_anti")


def without_project(table: DataFrame, sessions: DataFrame, project: str) -> DataFrame:
    """A table with session_id without the rows of a project, spelled exactly."""
    return table.join(sessions.where(F.col("project_slug") == project).select("session_id"), "session_id", "left_anti")


def missing_sessions(sessions: DataFrame, listing: DataFrame, walked: list[str]) -> DataFrame:
    """Sessions of the walked projects whose file is gone: to be swept, or kept as archived."""
    return sessions.where(F.col("project_slug").isin(walked)).join(listing.select("file_path"), "file_path", "left_anti")


def migrate_project(sessions: DataFrame, old_slug: str, new_slug: str, old_root: str, new_root: str, force: bool = False) -> DataFrame:
    """Sessions with one project moved to another slug and folder. ValueError if the new one has sessions, unless forced."""
    if not force and not sessions.where(F.col("project_slug") == new_slug).isEmpty():
        raise ValueError(f"{new_slug!r} has sessions")
    mine = F.col("project_slug") == old_slug
    moved = F.when(mine & F.col("file_path").startswith(old_root), F.concat(F.lit(new_root), F.substring("file_path", len(old_root) + 1, 1 << 30))).otherwise(F.col("file_path"))
    return sessions.withColumn("file_path", moved).withColumn("project_slug", F.when(mine, new_slug).otherwise(F.col("project_slug")))


def migration_totals(sessions: DataFrame, messages: DataFrame, slug: str) -> DataFrame:
    """Sessions and messages that a move of this project would touch."""
    mine = sessions.where(F.col("project_slug") == slug).select("session_id")
    n = messages.join(mine, "session_id", "left_semi").agg(F.count(F.lit(1)).alias("n_messages"))
    return mine.agg(F.count(F.lit(1)).alias("n_sessions")).crossJoin(n)


def store(df: DataFrame, path: str, partition: str | None = "project_slug") -> None:
    """Write a table so that only the partitions in df change; without a partition column, all of it. df must not read from path."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(partition) if partition else w).parquet(path)
