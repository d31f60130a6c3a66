"""The command line, the embedding service's client, moves of projects and commits of an archive."""

import io
import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from threadloom import cli
from threadloom.functions.settings import exit_code, lint
from threadloom.operators.embed import EmbeddingError, HashEmbedder, HttpEmbedder
from threadloom.plans.archive import Archive


class Service(BaseHTTPRequestHandler):
    """Stands in for an embedding service; `faults` makes it fail in a way."""

    fault, seen = "", []

    def _say(self, value, code=200):
        body = value if isinstance(value, bytes) else json.dumps(value).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self._say({"version": "1.2"} if self.path == "/api/version" else {"models": [{"name": "small:latest"}]})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append(body)
        if Service.fault == "refuse":
            return self._say(b"input length exceeds context", 400)
        if Service.fault == "text":
            return self._say(b"<html>")
        vectors = HashEmbedder(8).embed_batch(body["input"])
        self._say({"embeddings": vectors[1:] if Service.fault == "short" else vectors})

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    Service.fault, Service.seen = "", []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()
    server.server_close()


def test_client(service):
    c = HttpEmbedder(service, "small", max_chars=3, keep_alive="30m")
    assert np.allclose(c.embed_batch(["abc def", "x"]), HashEmbedder(8).embed_batch(["abc", "x"])) and c.embed_batch([]) == []
    assert Service.seen == [{"model": "small", "input": ["abc", "x"], "keep_alive": "30m"}]
    got = c.probe()
    assert (got.reachable, got.version, got.model_present, got.embed_ok, got.dim, got.error) == (True, "1.2", True, True, 8, None)
    for fault, words in (("refuse", "400 .*exceeds context"), ("text", "/api/embed"), ("short", "2 texts")):
        Service.fault = fault
        with pytest.raises(EmbeddingError, match=words):
            c.embed_batch(["a", "b"])
    got = c.probe()
    assert got.model_present and not got.embed_ok and got.error
    other = HttpEmbedder(service, "large").probe()
    assert other.reachable and not other.model_present and "large" in other.error
    nobody = HttpEmbedder("http://127.0.0.1:9", timeout=1).probe()
    assert not nobody.reachable and nobody.error


def line(role, content, ts="2024-01-01T00:00:00Z"):
    return json.dumps({"timestamp": ts, "message": {"role": role, "content": content}}) + "\n"


@pytest.fixture
def setup(tmp_path):
    p = tmp_path / "root" / "proj"
    p.mkdir(parents=True)
    (p / "one.jsonl").write_text("".join(line("user", f"the penguin number {k}") for k in range(3)))
    (p / "two.jsonl").write_text(line("user", "a rocket") + line("assistant", "Let me check"))
    return tmp_path


@pytest.fixture
def run(spark, setup, capsys, service):
    toml = setup / "c.toml"
    toml.write_text(f"[archive]\nroot = '{setup}/root'\n[database]\npath = '{setup}/db'\n[embeddings]\nenabled = true\nollama_base_url = '{service}'\nmodel = 'small'\n[search]\nhook_days = 100000\nhook_threshold = 0.0\n")

    def go(*args, stdin=""):
        code = cli.main(["--config", str(toml), *args], spark, io.StringIO(stdin))
        return code, capsys.readouterr().out.strip()

    return go


def entries(setup):
    return sorted(n for n in os.listdir(setup / "db" / "catalog"))


def test_commands(setup, run):
    code, out = run("index")
    report = json.loads(out)
    assert code == 0 and (report["new"], report["auto_embed"]) == (2, {"embedded": 5, "dropped": 0})
    assert len(entries(setup)) == 2
    assert json.loads(run("index", "--no-embed")[1])["unchanged"] == 2 and len(entries(setup)) == 2
    assert json.loads(run("embed")[1]) == {"embedded": 0, "dropped": 0, "skipped": 5}
    assert run("embed", "--probe")[0] == 0
    code, out = run("search", "penguins", "--days", "100000", "--limit", "2", "--format", "json")
    found = json.loads(out)
    assert (found["total_matches"], found["returned"]) == (3, 2)
    assert "penguin" in run("show", "one", "--turns", "1")[1] and run("show", "none")[0] == 1
    assert "one" in run("list", "--days", "100000")[1]
    assert json.loads(run("status")[1])["n_messages"] == 5
    assert run("status", "--integrity-check")[0] == 0
    context = json.loads(run("emit-prompt-context", stdin=json.dumps({"prompt": "where is the rocket"}))[1])
    assert "rocket" in context["hookSpecificOutput"]["additionalContext"]
    assert run("emit-prompt-context", stdin="junk") == (0, "{}")
    assert "PROCEDURAL" in run("reclassify", "--dry-run")[1]
    assert json.loads(run("topics", "--format", "json", "--min-cluster-size", "2")[1])["total_messages_clustered"] == 4
    assert run("topics", "--since", "soon")[0] == 2
    assert json.loads(run("scrub-images", "--dry-run")[1])["scanned"] == 2
    code, out = run("orphan-slugs", "--path", "/there")
    assert code == 1 and "proj orphan" in out and "-there missing" in out
    (setup / "s.json").write_text('{"hooks": {}}')
    assert run("doctor", str(setup / "s.json")) == (0, "OK")
    assert json.loads(run("vacuum")[1])["deleted"] > 0 and json.loads(run("status")[1])["n_messages"] == 5


def test_moving_a_project(spark, setup, run, monkeypatch):
    run("index")
    root = setup / "root"
    assert json.loads(run("migrate", "--from", "proj", "--to", "new", "--dry-run")[1]) == {"n_sessions": 2, "n_messages": 5, "n_vectors": 5, "moved": False}
    assert (root / "proj").is_dir() and not (root / "new").exists()
    assert json.loads(run("migrate", "--from", "proj", "--to", "new")[1])["moved"]
    a = Archive(spark, str(setup / "db"))
    assert {(r.project_slug, r.file_path) for r in a.sessions.collect()} == {("new", f"{root}/new/one.jsonl"), ("new", f"{root}/new/two.jsonl")}
    assert json.loads(run("index")[1])["unchanged"] == 2 and a.vectors.count() == 5
    assert run("migrate", "--from", "gone", "--to", "x")[0] == 2 and run("migrate", "--from", "new", "--to", "new")[0] == 2
    (root / "other").mkdir()
    (root / "other" / "kept.jsonl").write_text(line("user", "mine"))
    assert run("migrate", "--from", "new", "--to", "other")[0] == 2

    def fail(self, **tables):
        raise OSError("full")

    monkeypatch.setattr(Archive, "_commit", fail)
    with pytest.raises(OSError, match="full"):
        a.relocate(str(root), "new", "other", force=True)
    assert sorted(os.listdir(root)) == ["new", "other"] and os.listdir(root / "other") == ["kept.jsonl"]
    monkeypatch.undo()
    assert a.relocate(str(root), "new", "other", force=True)["moved"]
    assert sorted(os.listdir(root / "other")) == ["one.jsonl", "two.jsonl"]


def test_following_a_root(spark, setup):
    a = Archive(spark, str(setup / "db"))

    def seen():
        a.follow(str(setup / "root"), str(setup / "check")).awaitTermination()
        return a.sessions.count(), a.messages.count()

    assert seen() == (2, 5) and seen() == (2, 5) and len(entries(setup)) == 1
    with open(setup / "root" / "proj" / "two.jsonl", "a") as f:
        f.write(line("user", "grown"))
    (setup / "root" / "proj" / "three.jsonl").write_text(line("user", "new"))
    assert seen() == (3, 7) and len(entries(setup)) == 2


@pytest.mark.parametrize(
    ("command", "shell", "there", "code"),
    [
        ("/x/run.sh", None, True, 2),
        ("/x/run.sh", "bash", True, 0),
        ("/x/run.sh", "bash", False, 2),
        ('"C:\\\\bin\\\\tool.exe" --all', None, True, 0),
        ("tool.cmd", None, False, 2),
        ("tool --all", None, False, 0),
        ("${HOME}/tool", None, False, 0),
        ("@{ a = 1 }", None, False, 0),
    ],
)
def test_paths_in_settings(command, shell, there, code):
    hook = {"type": "command", "command": command} | ({"shell": shell} if shell else {})
    found = lint(json.dumps({"hooks": {"Start": [{"hooks": [hook]}]}}), exists=lambda p: there)
    assert exit_code(found) == code
