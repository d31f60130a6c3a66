"""Sources around an archive, scrubbing of files, context for prompts, and that unchanged files stay unopened."""

import base64
import json
import os
import struct

import pytest

from threadloom.functions.images import image_size
from threadloom.operators.scrub import scrub_files, scrub_report
from threadloom.plans.archive import Archive
from threadloom.plans.prompt import batch_context, prompt_context
from threadloom.sources import projects


def turn(role, text, at="2026-11-01T10:00:00Z"):
    return json.dumps({"type": role, "timestamp": at, "message": {"role": role, "content": text}})


@pytest.fixture
def root(tmp_path):
    for project, session, lines in (("p-one", "aaa1", ["zebra stripes in the parser", "fixed the parser"]), ("p-one", "aab2", ["weather report"]), ("p-two", "bbb3", ["zebra crossing"])):
        d = tmp_path / "archive" / project
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{session}.jsonl").write_text("\n".join(turn("user", x) for x in lines) + "\n")
    (tmp_path / "archive" / ".hidden").mkdir()
    return str(tmp_path / "archive")


def test_session_files(spark, root):
    names = lambda df: [(r.project_slug, r.session_id) for r in df.collect()]
    assert names(projects.session_files(spark, root)) == [("p-one", "aaa1"), ("p-one", "aab2"), ("p-two", "bbb3")]
    assert names(projects.session_files(spark, root, "p-one", "aab")) == [("p-one", "aab2")]
    assert names(projects.session_files(spark, root, "none")) == [] and names(projects.session_files(spark, root + "x")) == []
    assert [r.slug for r in projects.archive_slugs(spark, root).collect()] == ["p-one", "p-two"] and projects.archive_slugs(spark, root + "x").count() == 0


def test_project_roots_and_folders(spark, tmp_path):
    f = tmp_path / "projects.json"
    f.write_text(json.dumps([{"rootPath": "/B"}, {"rootPath": "Root Path"}, {"rootPath": "/a"}, {"rootPath": "/b"}, {"rootPath": " "}, {"x": 1}, 3, {"rootPath": 5}]))
    assert [r.path for r in projects.project_roots(spark, str(f)).collect()] == ["/B", "/a"]
    for text in ("{", "{}", "[]"):
        f.write_text(text)
        assert projects.project_roots(spark, str(f)).count() == 0
    assert projects.project_roots(spark, str(tmp_path / "none")).count() == 0
    for name in ("one", ".git", "node_modules", "two"):
        (tmp_path / "dev" / name).mkdir(parents=True)
    (tmp_path / "dev" / "file").write_text("")
    assert [os.path.basename(r.path) for r in projects.child_folders(spark, str(tmp_path / "dev")).collect()] == ["one", "two"]
    assert projects.child_folders(spark, str(f)).count() == 0


def test_interventions(tmp_path, monkeypatch):
    (tmp_path / "i.md").write_text("  be brief \n")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00")
    monkeypatch.chdir(tmp_path)
    assert projects.interventions("i.md") == projects.interventions(str(tmp_path / "i.md")) == "be brief"
    assert projects.interventions("none.md") == projects.interventions("bad.md") == projects.interventions(None) == projects.interventions("i.md", False) == ""


def image_line(width):
    data = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", width, 10) + b"\0" * 20
    return json.dumps({"message": {"content": [{"type": "image", "source": {"type": "base64", "data": base64.b64encode(data).decode()}}]}})


def test_scrub_files(spark, tmp_path):
    d = tmp_path / "a" / "p"
    d.mkdir(parents=True)
    (d / "s1.jsonl").write_text(f"{image_line(3000)}\nnot json\n{image_line(10)}\n")
    (d / "s2.jsonl").write_text(f"{image_line(10)}\r\nlast")
    before = {f: (d / f).read_bytes() for f in ("s1.jsonl", "s2.jsonl")}
    files = projects.session_files(spark, str(tmp_path / "a"))
    dry = scrub_report(scrub_files(files, dry_run=True))
    assert (dry["scanned"], dry["modified"], dry["images"]) == (2, 0, 1) and {f: (d / f).read_bytes() for f in before} == before
    done = scrub_files(files)
    assert scrub_report(done)["modified"] == 1 and sorted(os.listdir(d))[0] == "s1.jsonl" and len(os.listdir(d)) == 3
    copy = next(f for f in os.listdir(d) if ".bak." in f)
    assert (d / copy).read_bytes() == before["s1.jsonl"] and (d / "s2.jsonl").read_bytes() == before["s2.jsonl"]
    lines = (d / "s1.jsonl").read_text().split("\n")
    assert "image removed: 3000x10" in lines[0] and lines[1:] == ["not json", image_line(10), ""]
    again = scrub_report(scrub_files(files))
    assert again["images"] == 0 and again["removed_before"] == 1 and again["modified"] == 0


def test_jpeg_with_a_stray_byte():
    frame = b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 10
    assert image_size(b"\xff\xd8\x00\x00" + frame) == (9, 7) and image_size(b"\xff\xd8" + b"\0" * 30) is None


def test_unchanged_files_are_not_opened(spark, root, tmp_path):
    a = Archive(spark, str(tmp_path / "db"))
    assert not a.has_sessions() and a.capabilities() == {"text_search": True, "index_built": False, "index_complete": False, "vectors": False}
    assert a.index(root)["new"] == 3 and a.has_sessions() and a.capabilities()["index_complete"]
    # what these files hold now would be malformed, but their times are known
    for name in ("aaa1", "aab2"):
        f = os.path.join(root, "p-one", f"{name}.jsonl")
        at = os.stat(f)
        with open(f, "w") as w:
            w.write("{ broken")
        os.utime(f, ns=(at.st_atime_ns, at.st_mtime_ns))
    with open(os.path.join(root, "p-two", "bbb3.jsonl"), "a") as w:
        w.write(turn("user", "one more turn") + "\n")
    os.utime(os.path.join(root, "p-two", "bbb3.jsonl"), (2_000_000_000, 2_000_000_000))
    report = a.index(root)
    assert (report["new"], report["updated"], report["unchanged"], report["malformed"]) == (0, 1, 2, 0)
    assert a.messages.count() == 5 and a.index(root)["updated"] == 0 and a.messages.count() == 5


def test_context_for_prompts(spark, root, tmp_path):
    a = Archive(spark, str(tmp_path / "db"))
    a.index(root)
    (tmp_path / "i.md").write_text("be brief")
    ask = lambda text, **more: json.loads(prompt_context(a, text, **more))
    got = ask(json.dumps({"prompt": "where are the zebra stripes?"}), instructions=str(tmp_path / "i.md"))["hookSpecificOutput"]["additionalContext"]
    assert got.startswith("be brief\n\n---\n\nRelevant") and "zebra" in got
    for text in ("", "{", "[]", json.dumps({"prompt": 3}), json.dumps({"prompt": ""})):
        assert ask(text) == {}
    assert ask(json.dumps({"prompt": "nothing matches xylophone"})) == {}
    prompts = spark.createDataFrame([(1, "zebra stripes"), (2, "crossing"), (3, None), (4, "")], "query_id long, text string")
    rows = [(r.query_id, r["rank"], r.session_id) for r in batch_context(a, prompts).orderBy("query_id", "rank").collect()]
    assert rows == [(1, 1, "aaa1"), (1, 2, "bbb3"), (2, 1, "bbb3")]
    assert [(r.query_id, r.session_id) for r in batch_context(a, prompts, project="P-Two").orderBy("query_id").collect()] == [(1, "bbb3"), (2, "bbb3")]
