"""Tables of an archive: columns, versions and their evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSIONS = "session_id string, project_slug string, file_path string, file_mtime double, started_at string, ended_at string, turn_count int, indexed_at string"
MESSAGES = "msg_id long, session_id string, role string, content string, turn_index int, timestamp string, content_hash string, content_kind string"
VECTORS = "msg_id long, vector array<float>, model string, dim int, embedded_at string"
SCHEMA_VERSION = 3


def content_hash(content):
    """Change detector of a message's content: 128 bits of SHA-256 in hex. Native, unlike keyed or tree hashes."""
    return F.substring(F.sha2(content, 256), 1, 32)


def upgrade_messages(messages: DataFrame) -> DataFrame:
    """Messages of any earlier version in today's columns: content_hash and content_kind are added or filled where they are missing. Idempotent."""
    from threadloom.functions.kinds import kind_of

    have = set(messages.columns)
    hashed = F.coalesce(F.col("content_hash"), content_hash(F.col("content"))) if "content_hash" in have else content_hash(F.col("content"))
    kind = F.coalesce(F.col("content_kind"), kind_of(F.col("content"), F.col("role"))) if "content_kind" in have else kind_of(F.col("content"), F.col("role"))
    return messages.withColumn("content_hash", hashed).withColumn("content_kind", kind)
