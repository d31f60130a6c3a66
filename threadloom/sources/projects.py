"""Where projects and sessions are: listings of folders, a project manager's file, and the standing instructions beside a project.

Listings of immediate folders are short and made on the driver; session files are listed by Spark, in any store that it reads.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.words import session_id_of

#: Folders that are no projects (fixed values).
NO_PROJECTS = ("__pycache__", "node_modules", "obj", "bin")
#: What the file says of a project before anyone has edited it (fixed value).
UNEDITED = "root path"
PATHS = "ord int, path string"


def session_files(spark: SparkSession, root: str, project: str | None = None, prefix: str | None = None) -> DataFrame:
    """(project_slug, session_id, file_path) of transcripts below root, of one project and of sessions with this prefix if given, ordered by path. Missing folders give no rows; nothing but names is read."""
    empty = spark.createDataFrame([], "project_slug string, session_id string, file_path string")
    where = f"{root.rstrip('/')}/{project}" if project else root.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(where).select(F.col("path").alias("file_path"))
    base = root.rstrip("/").removeprefix("file://")
    relative = F.substring_index("file_path", base + "/", -1)
    slug = F.substring_index(relative, "/", 1)
    rows = files.where(F.contains(relative, F.lit("/"))).select(slug.alias("project_slug"), session_id_of(F.substr(relative, F.length(slug) + 2, F.lit(1 << 30))).alias("session_id"), "file_path")
    if prefix:
        # by the file's own name, as sessions in subfolders are named by it too
        rows = rows.where(F.substring_index("file_path", "/", -1).startswith(prefix))
    return rows.orderBy("file_path")


def project_roots(spark: SparkSession, path: str) -> DataFrame:
    """(ord, path): the `rootPath` of each entry of a project manager's file, in order, without placeholders, blank ones and those that differ by case only. A missing or malformed file gives no rows."""
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        value = None
    found = [e["rootPath"] for e in value if isinstance(e, dict) and isinstance(e.get("rootPath"), str)] if isinstance(value, list) else []
    rows = spark.createDataFrame(list(enumerate(found)), PATHS)
    plain = F.lower(F.trim("path"))
    return rows.where((plain != "") & (plain != UNEDITED)).groupBy(F.lower("path").alias("key")).agg(F.min_by("path", "ord").alias("path"), F.min("ord").alias("ord")).select("ord", "path").orderBy("ord")


def child_folders(spark: SparkSession, root: str) -> DataFrame:
    """(ord, path): immediate folders of root that can be projects, by name; none if root isn't a folder."""
    names = sorted(e.name for e in os.scandir(root) if e.is_dir() and not e.name.startswith(".") and e.name not in NO_PROJECTS) if os.path.isdir(root) else []
    return spark.createDataFrame([(k, os.path.join(root, n)) for k, n in enumerate(names)], PATHS)


def archive_slugs(spark: SparkSession, root: str) -> DataFrame:
    """(slug) of an archive's folders that aren't hidden, in order; in any store that Spark reads. None if root is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return spark.createDataFrame([(n,) for n in sorted(names) if not n.startswith(".")], "slug string").orderBy("slug")


def interventions(path: str | None, inject: bool = True) -> str:
    """The standing instructions' text, stripped; a relative path is one from the working folder. Empty if switched off or for any error of reading."""
    if not inject or not path:
        return ""
    try:
        return Path(path).read_text(encoding="utf-8").strip()
    except (OSError, UnicodeDecodeError):
        return ""
