"""The archive's commands on a command line: `python -m threadloom.cli COMMAND`. Results go to stdout as text or JSON.

Exit codes: 0; 1 for what isn't there, or findings that warn; 2 for wrong arguments, errors found and messages that couldn't be embedded.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import settings
from threadloom.functions.words import slug_of
from threadloom.operators import archive_views, embed, fts, orphans, search, topics
from threadloom.plans.archive import Archive
from threadloom.plans.prompt import prompt_context
from threadloom.sources import config, projects


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="threadloom")
    top.add_argument("--config", help="TOML file of settings")
    top.add_argument("--archive", help="folder of the archive's tables; database.path of the settings if not given")
    top.add_argument("--archive-root", help="folder of the transcripts; archive.root of the settings if not given")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *flags: str, form: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        for f in flags:
            p.add_argument(f, action="store_true")
        if form:
            p.add_argument("--format", choices=form, default=form[0])
        return p

    p = command("index", "bring the archive up to date", "--rebuild", "--no-embed")
    p.add_argument("--project")
    p = command("search", "ranked search", "--extract-keywords", "--semantic", "--boost", form=("text", "json", "agent-context"))
    p.add_argument("query")
    p.add_argument("--days", type=int, default=90)
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--project")
    p.add_argument("--kind", action="append")
    p = command("show", "a session's turns", form=("text", "json"))
    p.add_argument("session")
    p.add_argument("--turns", help="a-b, -n or n")
    p = command("list", "newest sessions", form=("text", "json"))
    p.add_argument("--project")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--days", type=int, default=30)
    command("status", "counts and health", "--integrity-check")
    p = command("embed", "vectors for messages without one", "--rebuild", "--probe")
    p.add_argument("--project")
    p = command("topics", "themes of what was said", form=("text", "json", "agent-context"))
    p.add_argument("--project")
    p.add_argument("--since", help="ISO date or time, or a span such as 7d")
    p.add_argument("--similarity-threshold", type=float, default=topics.THRESHOLD)
    p.add_argument("--min-cluster-size", type=int, default=topics.MIN_SIZE)
    p.add_argument("--limit", type=int, default=topics.LIMIT)
    p = command("migrate", "move a project to another slug", "--force", "--dry-run")
    p.add_argument("--from", dest="old", required=True)
    p.add_argument("--to", dest="new", required=True)
    p = command("emit-prompt-context", "context for a prompt hook's input on stdin")
    p.add_argument("--project")
    p = command("doctor", "lint a document of hook settings")
    p.add_argument("settings")
    p = command("orphan-slugs", "folders that no project expects")
    p.add_argument("--projects-json")
    p.add_argument("--path", action="append", default=[])
    p.add_argument("--projects-root", action="append", default=[])
    p.add_argument("--old-style-marker", action="append")
    p = command("scrub-images", "oversized images out of transcripts", "--dry-run", "--no-backup")
    p.add_argument("--project")
    p.add_argument("--session")
    p.add_argument("--max-dim", type=int)
    p.add_argument("--max-bytes", type=int)
    command("reclassify", "kinds by today's rules", "--dry-run")
    command("vacuum", "delete tables that aren't in use any more")
    return top


class Commands:
    """A method a command, named by it; each returns the exit code and what to print."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace, stdin):
        self.spark, self.args, self.stdin = spark, args, stdin
        self.config = config.load(args.config)
        self.root = args.archive_root or self.config.archive_root
        self.archive = Archive(spark, args.archive or self.config.database_path)

    def _service(self, patient: bool = False) -> embed.HttpEmbedder:
        e = self.config.embeddings
        # a probe may have to wait for the service to load its model
        return embed.HttpEmbedder(e.ollama_base_url, e.model, max(e.request_timeout_seconds, 30.0) if patient else e.request_timeout_seconds, e.max_input_chars, e.keep_alive)

    def index(self):
        a, e = self.args, self.config.embeddings
        before = self.archive.status()["n_messages"] if not a.rebuild else 0
        report = self.archive.index(self.root, a.project, a.rebuild, self.config.indexing.index_tool_blocks, self.config.indexing.sweep_orphans)
        if e.enabled and not a.no_embed:
            client, new = self._service(), self.archive.status()["n_messages"] - before
            few = 0 < new <= embed.AUTO_LIMIT
            report["auto_embed"] = self.archive.auto_embed(lambda: client, e.model, new, True, few and client.probe().reachable)
        return 0, json.dumps(report)

    def search(self):
        a = self.args
        client = self._service() if a.semantic or self.config.embeddings.enabled else None
        r = self.archive.search(a.query, days=a.days, limit=a.limit, project=a.project, threshold=a.threshold, extract_keywords=a.extract_keywords, embedder=client, pool_size=self.config.embeddings.rerank_pool_size, boost=a.boost, kinds=a.kind)
        return 0, search.format_response(r, a.format)

    def show(self):
        rows = [r.asDict() for r in self.archive.show(self.args.session, self.args.turns).select("turn_index", "role", "timestamp", "content").collect()]
        if self.args.format == "json":
            return 0, json.dumps(rows, ensure_ascii=False, indent=2)
        return 0, "\n\n".join(f"[{r['turn_index']}] {r['role']} {r['timestamp'] or ''}\n{r['content']}" for r in rows)

    def list(self):
        a = self.args
        since = search.since_days(a.days)
        recent = self.archive.sessions.where(F.col("started_at").isNull() | (F.col("started_at") >= since))
        rows = [r.asDict() for r in archive_views.list_sessions(recent, self.archive.messages, a.limit, a.project).collect()]
        if a.format == "json":
            return 0, json.dumps(rows, ensure_ascii=False, indent=2)
        return 0, "\n".join(f"{r['session_id']}  {r['started_at'] or '-'}  {r['project_slug']}  {r['turn_count']} turns  {(r['first_user'] or '')[:80]!r}" for r in rows)

    def status(self):
        if not self.args.integrity_check:
            return 0, json.dumps(self.archive.status() | self.archive.capabilities())
        s, m, v = self.archive.sessions, self.archive.messages, self.archive.vectors
        found = {"sessions_with_gaps": archive_views.turn_gaps(s, m).count(), "orphan_messages": archive_views.orphan_messages(s, m).count(), "not_indexed": archive_views.missing_from_index(m, self.archive.text_index.doc_stats).count()}
        by_project = [r.asDict() for r in archive_views.project_totals(s, m, v).orderBy("project_slug").collect()]
        return int(any(found.values())), json.dumps(found | {"projects": by_project})

    def embed(self):
        a, client = self.args, self._service(self.args.probe)
        if a.probe:
            got = client.probe()
            return 0 if got.embed_ok else 2, json.dumps(asdict(got), ensure_ascii=False)
        if not self.config.embeddings.enabled:
            return 1, "embeddings are switched off in the settings"
        skipped = 0 if a.rebuild else self.archive.embedded(a.project)
        counts = self.archive.embed(lambda: client, client.model, a.project, a.rebuild)
        return 2 if counts["dropped"] else 0, json.dumps(counts | {"skipped": skipped})

    def topics(self):
        a = self.args
        found = self.archive.topics(project=a.project, since=topics.parse_since(a.since), threshold=a.similarity_threshold, min_size=a.min_cluster_size, limit=a.limit)
        return 0, topics.format_topics(found, a.format)

    def migrate(self):
        a = self.args
        return 0, json.dumps(self.archive.relocate(self.root, a.old, a.new, a.force, a.dry_run))

    def emit_prompt_context(self):
        h = self.config.hooks
        return 0, prompt_context(self.archive, self.stdin.read(), self.config, self.args.project, h.interventions_path if h.inject_interventions else None)

    def doctor(self):
        with open(self.args.settings, encoding="utf-8") as f:
            found = settings.lint(f.read())
        return settings.exit_code(found), "\n".join(f"{s}: {m}" for s, m in found) or "OK"

    def orphan_slugs(self):
        a, spark = self.args, self.spark
        paths: list[DataFrame] = [projects.project_roots(spark, a.projects_json)] if a.projects_json else []
        paths += [projects.child_folders(spark, r) for r in a.projects_root]
        paths.append(spark.createDataFrame(list(enumerate(a.path)), projects.PATHS))
        expected = reduce(DataFrame.unionByName, paths).select(slug_of(F.col("path")).alias("slug"))
        found = orphans.reconcile(projects.archive_slugs(spark, self.root), expected, tuple(a.old_style_marker or orphans.MARKERS)).cache()
        text = "\n".join(f"{r.severity}: {r.slug} {r.state}{f' -> {r.successor}' if r.successor else ''}" for r in found.orderBy("severity", "slug").toLocalIterator())
        return orphans.exit_code(found), text or "OK"

    def scrub_images(self):
        a = self.args
        limits = {k: v for k, v in (("max_dim", a.max_dim), ("max_bytes", a.max_bytes)) if v is not None}
        return 0, json.dumps(self.archive.scrub_images(self.root, a.project, a.session, dry_run=a.dry_run, backup=not a.no_backup, **limits))

    def reclassify(self):
        return 0, json.dumps(self.archive.reclassify(self.args.dry_run))

    def vacuum(self):
        return 0, json.dumps({"deleted": self.archive.vacuum()})


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin=None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from threadloom.session import session

        spark = session()
    try:
        code, text = getattr(Commands(spark, args, stdin or sys.stdin), args.command.replace("-", "_"))()
    except (LookupError, FileNotFoundError) as e:
        print(f"not found: {e}", file=sys.stderr)
        return 1
    except (ValueError, fts.QueryError) as e:
        print(e, file=sys.stderr)
        return 2
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
