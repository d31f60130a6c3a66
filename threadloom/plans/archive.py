"""An archive on disk: its tables, and the commands that read and change them.

Each change writes whole new tables beside the old ones and then one small catalog entry that names them; readers take the
newest entry, so they see one state or the next. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.operators import archive_views, embed, fts, ingest, search, topics
from threadloom.sources import archive as transcripts

EMPTY = {"sessions": schema.SESSIONS, "messages": schema.MESSAGES, "vectors": schema.VECTORS, "postings": "term string, msg_id long, tf int, positions array<int>", "doc_stats": "msg_id long, dl int"}


class Archive:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # tables

    def _entries(self) -> DataFrame | None:
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/catalog")
        fs = jvm.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(jvm):
            return None
        return self.spark.read.schema("number long, name string, location string").option("recursiveFileLookup", True).json(f"{self.path}/catalog")

    def _current(self) -> tuple[int, dict[str, str]]:
        entries = self._entries()
        if entries is None:
            return 0, {}
        rows = entries.groupBy("name").agg(F.max("number").alias("number"), F.max_by("location", "number").alias("location")).collect()
        return max((r.number for r in rows), default=0), {r.name: r.location for r in rows}

    def table(self, name: str) -> DataFrame:
        where = self._current()[1].get(name)
        return self.spark.read.parquet(where) if where else self.spark.createDataFrame([], EMPTY[name])

    def _write(self, name: str, df: DataFrame) -> str:
        """A new table's place; no reader sees it before an entry names it."""
        where = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
        # postings sorted by term: a query's terms are in few row groups
        (df.sortWithinPartitions("term") if name == "postings" else df).write.parquet(where)
        return where

    def _enter(self, places: dict[str, str]) -> None:
        number, _ = self._current()
        rows = [(number + 1, name, where) for name, where in places.items()]
        self.spark.createDataFrame(rows, "number long, name string, location string").coalesce(1).write.json(f"{self.path}/catalog/{number + 1:09d}")

    def _commit(self, **tables: DataFrame) -> None:
        self._enter({name: self._write(name, df) for name, df in tables.items()})

    @property
    def sessions(self) -> DataFrame:
        return self.table("sessions")

    @property
    def messages(self) -> DataFrame:
        return self.table("messages")

    @property
    def vectors(self) -> DataFrame:
        return self.table("vectors")

    @property
    def text_index(self) -> fts.Index:
        return fts.Index(self.table("postings"), self.table("doc_stats"))

    # commands

    def index(self, root: str, project: str | None = None, rebuild: bool = False, tool_blocks: bool = False, sweep: bool = False, now: str | None = None) -> dict:
        """Bring the archive up to date with the transcripts below root; counts of what happened. Files whose time is known are listed but not opened.

        Messages, sessions, text index and vectors change in one entry; a run that finds nothing to do writes nothing.
        """
        sessions, messages = self.sessions, self.messages
        if rebuild:
            gone = sessions if project is None else sessions.where(F.col("project_slug") == project)
            messages = messages.join(gone.select("session_id"), "session_id", "left_anti")
            sessions = sessions.join(gone.select("session_id"), "session_id", "left_anti")
        listing = transcripts.list_files(self.spark, root, project)
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
        listing = listing.withColumn("file_path", plain("file_path"))
        # names of files that have changed, as Spark's own listing holds them: only these are opened
        changed = [r.file_path for r in ingest.changed_files(listing, sessions).select("file_path").collect()]
        new_sessions, new_messages = transcripts.read_archive(self.spark, root, project, tool_blocks, now or datetime.now(UTC).isoformat(), changed)
        new_sessions = new_sessions.withColumn("file_path", plain("file_path")).cache()
        after, _ = ingest.upsert_messages(messages, new_messages)
        known = sessions.select("session_id")
        report = {"new": new_sessions.join(known, "session_id", "left_anti").count(), "updated": new_sessions.join(known, "session_id", "left_semi").count(), "malformed": new_sessions.agg(F.coalesce(F.sum("malformed"), F.lit(0))).first()[0]}
        report["unchanged"] = listing.count() - report["new"] - report["updated"]
        kept = ingest.upsert_sessions(sessions, new_sessions.drop("malformed").select(*sessions.columns))
        walked = [project] if project else [r[0] for r in new_sessions.select("project_slug").unionByName(sessions.select("project_slug")).distinct().collect()]
        missing = ingest.missing_sessions(kept, listing, walked)
        report["swept" if sweep else "archived"] = missing.count()
        if sweep:
            after = after.join(missing.select("session_id"), "session_id", "left_anti")
            kept = kept.join(missing.select("session_id"), "session_id", "left_anti")
        idle = not changed and not rebuild and not (sweep and report["swept"])
        if not idle or not self._index_matches(messages):
            # read back once written, as index and vectors both follow from the ids
            places = {"sessions": self._write("sessions", kept), "messages": self._write("messages", after.select(*messages.columns))}
            stored = self.spark.read.parquet(places["messages"])
            fresh = self._refreshed(stored)
            tables = {"postings": fresh.postings, "doc_stats": fresh.doc_stats, "vectors": ingest.surviving_vectors(self.vectors, stored)}
            self._enter(places | {name: self._write(name, df) for name, df in tables.items()})
        new_sessions.unpersist()
        return report

    def follow(self, root: str, checkpoint: str, **options):
        """Start a stream of the transcripts that come below root: each batch with new files brings the whole archive up to date, files that have grown included. It ends when all files present have been seen; a batch that runs again changes nothing."""
        files = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        names = files.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root).select("path")

        def update(batch: DataFrame, _: int) -> None:
            if not batch.isEmpty():
                self.index(root, **options)

        return names.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(update).start()

    def _index_matches(self, messages: DataFrame) -> bool:
        """Whether the text index holds these messages and no others, by their ids."""
        ids = self.text_index.doc_stats.select("msg_id")
        return messages.join(ids, "msg_id", "left_anti").isEmpty() and ids.join(messages, "msg_id", "left_anti").isEmpty()

    def _refreshed(self, messages: DataFrame) -> fts.Index:
        idx = self.text_index
        fresh = messages.join(idx.doc_stats, "msg_id", "left_anti").select("msg_id", "content")
        gone = idx.doc_stats.join(messages, "msg_id", "left_anti").select("msg_id")
        return fts.refresh(idx, fresh, gone)

    def refresh_index(self) -> None:
        """Postings of messages that have come, without those of messages that are gone."""
        new = self._refreshed(self.messages)
        self._commit(postings=new.postings, doc_stats=new.doc_stats)

    def vacuum(self) -> int:
        """Delete tables that no longer are the newest of their name; how many. Readers of older states must be done."""
        kept = {where.rsplit("/", 1)[-1] for where in self._current()[1].values()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName() not in kept] if kept and fs.exists(path) else []
        return sum(fs.delete(x, True) for x in old)

    def search(self, query: str, **options) -> search.Response:
        return search.search(self.text_index, self.messages, self.sessions, query, vectors=self.vectors if options.get("embedder") else None, **options)

    def embed(self, factory, model: str, project: str | None = None, rebuild: bool = False, now: str | None = None) -> dict:
        vectors, messages = self.vectors, self.messages
        if rebuild:
            vectors = ingest.delete_vectors(vectors, messages, self.sessions, project)
        if project:
            messages = messages.join(self.sessions.where(F.lower("project_slug") == project.lower()), "session_id", "left_semi")
        done = embed.embed_backlog(messages, vectors, factory, model, now or datetime.now(UTC).isoformat()).cache()
        counts = embed.embed_counts(done).first().asDict()
        self._commit(vectors=ingest.upsert_vectors(vectors, done.where("vector is not null").drop("error")))
        done.unpersist()
        return counts

    def embedded(self, project: str | None = None) -> int:
        """Messages, of a project if given, that have a vector."""
        messages = self.messages
        if project:
            messages = messages.join(self.sessions.where(F.lower("project_slug") == project.lower()), "session_id", "left_semi")
        return messages.join(self.vectors, "msg_id", "left_semi").count()

    def auto_embed(self, factory, model: str, new_messages: int, enabled: bool, reachable: bool) -> dict | None:
        """Embed what an index run brought if it is a few messages and the service is there; None if not. A failure is told, not raised: the index stands."""
        if not embed.should_auto_embed(new_messages, enabled, reachable):
            return None
        try:
            return self.embed(factory, model)
        except Exception as e:  # the embedding comes on top of an index run that has succeeded
            return {"embedded": 0, "dropped": 0, "error": str(e)}

    def topics(self, **options) -> dict:
        return topics.topics(self.vectors, self.messages, self.sessions, **options)

    def status(self) -> dict:
        return archive_views.status(self.sessions, self.messages, self.vectors).first().asDict()

    def has_sessions(self) -> bool:
        """Whether anything has been indexed; at most one row is read."""
        return not self.sessions.limit(1).isEmpty()

    def capabilities(self) -> dict:
        """What search can do here: whether the text index is built and covers all messages, and whether there are vectors."""
        idx, messages = self.text_index.doc_stats, self.messages
        built = "postings" in self._current()[1]
        return {"text_search": True, "index_built": built, "index_complete": built and messages.join(idx, "msg_id", "left_anti").isEmpty(), "vectors": not self.vectors.limit(1).isEmpty()}

    def scrub_images(self, root: str, project: str | None = None, session: str | None = None, **options) -> dict:
        """Oversized images out of the transcripts below root; see operators.scrub.scrub_files."""
        from threadloom.operators.scrub import scrub_files, scrub_report
        from threadloom.sources.projects import session_files

        return scrub_report(scrub_files(session_files(self.spark, root, project, session), **options))

    def list(self, limit: int = 20, project: str | None = None) -> DataFrame:
        return archive_views.list_sessions(self.sessions, self.messages, limit, project)

    def show(self, key: str, turns: str | None = None) -> DataFrame:
        """A session's turns, by its id or the beginning of it. LookupError if there is none."""
        r = archive_views.find_session(self.sessions, key).first()
        if r is None:
            raise LookupError(key)
        return archive_views.show_turns(self.messages, r.session_id, *archive_views.turn_range(turns, r.turn_count))

    def reclassify(self, dry_run: bool = False) -> dict:
        """Kinds before and after; unless dry_run, messages get the kinds that the rules give them now."""
        from threadloom.functions.kinds import kind_of

        m = self.messages
        report = {r.kind: (r.before, r.after) for r in archive_views.kind_changes(m).collect()}
        if not dry_run:
            self._commit(messages=m.withColumn("content_kind", kind_of(F.col("content"), F.col("role"))))
        return report

    def relocate(self, root: str, old_slug: str, new_slug: str, force: bool = False, dry_run: bool = False) -> dict:
        """A project's folder below root and its sessions under another slug; ids, and with them vectors, stay. Counts, and whether the folder moved.

        ValueError for one slug twice, a missing folder or one that is in the way; with force, that one is put aside and deleted once
        the change is in the catalog. If the catalog can't be written, the folders go back to where they were.
        """
        at = lambda slug: self.spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{slug}")
        source, target, aside = at(old_slug), at(new_slug), at(f".{new_slug}.{uuid.uuid4().hex}")
        fs = source.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if old_slug == new_slug:
            raise ValueError(f"{old_slug!r} is both slugs")
        if not fs.exists(source):
            raise ValueError(f"no folder {source}")
        there = fs.exists(target)
        if there and not force:
            raise ValueError(f"{target} exists")
        report = ingest.migration_totals(self.sessions, self.messages, old_slug).first().asDict()
        mine = self.messages.join(self.sessions.where(F.col("project_slug") == old_slug), "session_id", "left_semi")
        report |= {"n_vectors": self.vectors.join(mine, "msg_id", "left_semi").count(), "moved": False}
        base = root.rstrip("/").removeprefix("file://")
        changed = ingest.migrate_project(self.sessions, old_slug, new_slug, f"{base}/{old_slug}/", f"{base}/{new_slug}/", force)
        if dry_run:
            return report
        if there and not fs.rename(target, aside):
            raise OSError(f"can't put {target} aside")
        try:
            if not fs.rename(source, target):
                raise OSError(f"can't move {source}")
            report["moved"] = True
            self._commit(sessions=changed)
        except BaseException:
            if report["moved"]:
                fs.rename(target, source)
            if there:
                fs.rename(aside, target)
            raise
        if there:
            fs.delete(aside, True)
        return report

    def migrate(self, old_slug: str, new_slug: str, old_root: str, new_root: str, force: bool = False, dry_run: bool = False) -> dict:
        report = ingest.migration_totals(self.sessions, self.messages, old_slug).first().asDict()
        moved = ingest.migrate_project(self.sessions, old_slug, new_slug, old_root, new_root, force)
        if not dry_run:
            self._commit(sessions=moved)
        return report
