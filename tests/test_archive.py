import json
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import archive_views, embed, ingest, orphans, scrub, topics
from threadloom.schema import upgrade_messages
from threadloom.sources import archive, config
from threadloom.streaming.ingest import watch


def line(role, content, ts=None):
    return json.dumps({"type": role, "timestamp": ts, "message": {"role": role, "content": content}})


@pytest.fixture
def root(tmp_path):
    p = tmp_path / "archive" / "test-project"
    (p / "parent" / "subagents").mkdir(parents=True)
    (p / "short.jsonl").write_text("\n".join([line("user", "hello there", "2024-01-01T00:00:00Z"), line("assistant", [{"type": "text", "text": "Let me check"}], ""), line("user", "third", "2024-01-02T00:00:00Z"), "not json", "[1, 2]", line("user", "  "), line("assistant", [{"type": "tool_use", "id": "1", "name": "x", "input": {}}])]) + "\n\n")
    (p / "parent" / "subagents" / "agent-a.jsonl").write_text(line("user", "nested") + "\n")
    return str(tmp_path / "archive")


def test_reading(spark, root):
    sessions, messages = archive.read_archive(spark, root, now="n")
    s = {r.session_id: r for r in sessions.collect()}
    assert set(s) == {"short", "parent--subagents--agent-a"}
    assert (s["short"].turn_count, s["short"].malformed, s["short"].started_at, s["short"].ended_at, s["short"].project_slug) == (3, 1, "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "test-project")
    m = messages.where("session_id = 'short'").orderBy("turn_index").collect()
    assert [(r.turn_index, r.role, r.content_kind) for r in m] == [(0, "user", "THOUGHT"), (1, "assistant", "PROCEDURAL"), (2, "user", "THOUGHT")]
    assert archive.read_archive(spark, root, tool_blocks=True)[1].where("session_id = 'short'").count() == 4
    listing = archive.list_files(spark, root)
    assert listing.count() == 2 and ingest.changed_files(listing, sessions.limit(0)).count() == 2


def test_parse_line():
    assert archive.parse_line("{") is False and archive.parse_line("3") is None
    assert archive.parse_line('{"content": "x", "message": {"content": null}}') is None
    assert archive.parse_line('{"content": "x"}') == ("unknown", "x", None)
    assert archive.flatten([{"type": "tool_result", "content": [{"type": "text", "text": "deep"}]}], True) == "[tool_result] deep"


def table(spark, rows):
    return spark.createDataFrame(rows, "msg_id long, session_id string, role string, content string, turn_index int, timestamp string, content_hash string, content_kind string")


def test_upsert_keeps_ids_of_unchanged_turns(spark):
    old = table(spark, [(k, "s", "user", f"c{k}", k - 1, None, f"h{k}", None) for k in range(1, 6)] + [(9, "t", "user", "x", 0, None, "x", None)])
    new = table(spark, [(None, "s", "user", f"c{k}", k - 1, None, f"h{k}", None) for k in (1, 2)] + [(None, "s", "user", "edited", 2, None, "e", None), (None, "s", "user", "c4", 3, None, "h4", None)])
    after, gone = ingest.upsert_messages(old, new)
    got = {(r.session_id, r.turn_index): r.msg_id for r in after.collect()}
    assert got == {("s", 0): 1, ("s", 1): 2, ("s", 2): 10, ("s", 3): 4, ("t", 0): 9}
    assert sorted(r[0] for r in gone.collect()) == [3, 5]
    v = spark.createDataFrame([(k,) for k in range(1, 7)], "msg_id long")
    assert sorted(r[0] for r in ingest.surviving_vectors(v, after).collect()) == [1, 2, 4]


def test_upgrade_is_idempotent(spark):
    old = spark.createDataFrame([(1, "assistant", "Let me see")], "msg_id long, role string, content string")
    once = upgrade_messages(old)
    assert once.first().content_kind == "PROCEDURAL" and len(once.first().content_hash) == 32
    assert upgrade_messages(once).collect() == once.collect()


def test_sweep_migrate_and_vectors(spark):
    s = spark.createDataFrame([("a", "P", "/r/P/a.jsonl"), ("b", "P", "/r/P/b.jsonl"), ("c", "Q", "/r/Q/c.jsonl")], "session_id string, project_slug string, file_path string")
    listing = s.where("session_id = 'a'").select("file_path")
    assert [r.session_id for r in ingest.missing_sessions(s, listing, ["P"]).collect()] == ["b"]
    moved = ingest.migrate_project(s, "P", "N", "/r/P", "/r/N").orderBy("session_id").collect()
    assert [(r.project_slug, r.file_path) for r in moved] == [("N", "/r/N/a.jsonl"), ("N", "/r/N/b.jsonl"), ("Q", "/r/Q/c.jsonl")]
    with pytest.raises(ValueError):
        ingest.migrate_project(s, "P", "Q", "/r/P", "/r/Q")
    old = spark.createDataFrame([(1, [1.0], "m", 1, "a")], "msg_id long, vector array<float>, model string, dim int, embedded_at string")
    new = spark.createDataFrame([(1, [2.0], "m", 1, "b"), (1, [3.0], "m", 1, "c"), (2, [4.0], "m", 1, "b")], old.schema)
    assert sorted((r.msg_id, r.vector) for r in ingest.upsert_vectors(old, new).collect()) == [(1, [3.0]), (2, [4.0])]


def test_lookup(spark):
    s = spark.createDataFrame([("abc1", "P", "x"), ("abc2", "P", None), ("d", "P", None)], "session_id string, project_slug string, started_at string")
    assert archive_views.find_session(s, "D").count() == 1 and archive_views.find_session(s, "abc1").count() == 1
    with pytest.raises(ValueError, match="abc1"):
        archive_views.find_session(s, "abc")
    assert archive_views.turn_range("1-3", 9) == (1, 4) and archive_views.turn_range("-2", 9) == (7, 9) and archive_views.turn_range("4", 9) == (4, 5) and archive_views.turn_range("x", 9) == (0, 9)
    assert archive_views.resolve_project(s, "p") == "P" and archive_views.resolve_project(s, "new") == "new"


@pytest.fixture(scope="module")
def themed(spark):
    r = np.random.default_rng(0)
    rows, n = [], 0
    for c, word in enumerate(("penguin", "rocket")):
        for k in range(5):
            v = np.zeros(8)
            v[c] = 1
            rows.append((n, (v + r.normal(0, 0.05, 8)).tolist(), f"{word} habitat note", f"s{k % 2}", f"P{k % (c + 1)}"))
            n += 1
    rows.append((n, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0], "lonely", "s0", "P0"))
    rows.append((n + 1, [1.0, 2.0], "other length", "s0", "P0"))
    df = spark.createDataFrame(rows, "msg_id long, vector array<float>, content string, session_id string, project_slug string")
    vectors = df.select("msg_id", "vector")
    messages = df.select("msg_id", "session_id", F.lit("user").alias("role"), "content", F.lit(None).cast("string").alias("content_kind"), F.when(F.col("msg_id") < 5, "2024-01-01").alias("timestamp"))
    sessions = df.groupBy("session_id").agg(F.min("project_slug").alias("project_slug"), F.lit("2024-01-01").alias("started_at"))
    return vectors, messages, sessions


@pytest.mark.parametrize("spread", [False, True])
def test_topics(themed, spread):
    r = topics.topics(*themed, spread=spread)
    assert r["total_messages_clustered"] == 11
    if not spread:
        assert r["total_clusters"] == 2 and r["noise_count"] == 1 and {t["label"].split(" / ")[0] for t in r["themes"]} == {"penguin", "rocket"}
        assert len(r["themes"][0]["sample_messages"]) == 3 and "size=5" in topics.format_topics(r)
    late = topics.topics(*themed, since=datetime(2023, 1, 1, tzinfo=UTC))
    assert late["total_messages_clustered"] == 5
    assert topics.format_topics(topics.topics(*themed, project="none"), "agent-context") == "{}"


def test_since():
    now = datetime(2024, 3, 1, tzinfo=UTC)
    assert topics.parse_since("2w", now) == datetime(2024, 2, 16, tzinfo=UTC) and topics.parse_since(" ") is None
    assert topics.parse_since("2024-01-01") == datetime(2024, 1, 1, tzinfo=UTC)
    with pytest.raises(ValueError):
        topics.parse_since("soon")


class Picky(embed.HashEmbedder):
    def embed_batch(self, texts):
        if "bad" in texts:
            raise OSError("refused")
        return super().embed_batch(texts)


def test_embedding_drops_only_the_offender(spark):
    m = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, "done")], "msg_id long, content string")
    done = spark.createDataFrame([(4,)], "msg_id long")
    got = embed.embed_backlog(m.coalesce(1), done, Picky, "hash", "now")
    assert {r.msg_id: (r.dim, r.error) for r in got.collect()} == {1: (64, None), 2: (None, "refused"), 3: (64, None)}
    assert tuple(embed.embed_counts(got).first()) == (2, 1)
    assert embed.probe(Picky())[0] and not embed.probe(None)[0]
    for bad in ([[1.0]], [[float("nan")], [1.0]], [[0.0], [1.0]]):
        with pytest.raises(ValueError):
            embed.checked(bad, 2)


def test_orphans(spark):
    found = spark.createDataFrame([("e--Documents-Work-shop",), ("e--dev-shop",), ("x--lost",)], "slug string")
    expected = spark.createDataFrame([("e--dev-shop",), ("e--dev-new",)], "slug string")
    r = orphans.reconcile(found, expected)
    assert {(x.slug, x.state, x.successor) for x in r.collect()} == {("e--Documents-Work-shop", "pre_migration", "e--dev-shop"), ("x--lost", "orphan", None), ("e--dev-new", "missing", None)}
    assert orphans.exit_code(r) == 2 and orphans.exit_code(r.where("state = 'missing'")) == 0


def test_scrub(spark):
    df = spark.createDataFrame([("f", 0, '{"a": 1}'), ("f", 1, "junk"), ("f", 2, None)], "file_path string, pos int, line string")
    assert [(r.line, r.modified) for r in scrub.scrub(df).orderBy("pos").collect()] == [('{"a": 1}', False), ("junk", False), ("", False)]


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[search]\nhook_limit = 9\nnew = 1\n[archive]\nroot = '/a'\n")
    c = config.load(p)
    assert c.search.hook_limit == 9 and c.search.hook_days == 30 and c.archive_root == "/a" and config.load(tmp_path / "none").search.hook_limit == 3


def test_stream_sees_each_file_once(spark, root, tmp_path):
    seen = []

    def upsert(batch, number):
        seen.extend(r.content for r in batch.where("content is not null").collect())

    for _ in range(2):
        watch(spark, root, str(tmp_path / "check"), upsert).awaitTermination()
    assert sorted(seen) == ["Let me check", "hello there", "nested", "third"]
