import json

import pytest

from threadloom.functions.settings import exit_code, lint
from threadloom.operators.embed import HashEmbedder
from threadloom.plans.archive import Archive


def line(role, content, ts="2024-01-01T00:00:00Z"):
    return json.dumps({"timestamp": ts, "message": {"role": role, "content": content}}) + "\n"


def test_life_of_an_archive(spark, tmp_path):
    p = tmp_path / "root" / "proj"
    p.mkdir(parents=True)
    (p / "one.jsonl").write_text("".join(line("user", f"the penguin number {k}") for k in range(5)))
    (p / "two.jsonl").write_text(line("user", "a rocket") + line("assistant", "Let me check") + "bad\n")
    a = Archive(spark, str(tmp_path / "db"))
    root = str(tmp_path / "root")
    assert a.status()["n_sessions"] == 0
    assert a.index(root) == {"new": 2, "updated": 0, "malformed": 1, "unchanged": 0, "archived": 0}
    assert a.index(root)["unchanged"] == 2
    assert a.embed(HashEmbedder, "hash") == {"embedded": 7, "dropped": 0}
    ids = {r.turn_index: r.msg_id for r in a.show("one").collect()}
    # a middle turn edited, one added
    text = "".join(line("user", f"the penguin number {k}" if k != 2 else "changed") for k in range(6))
    (p / "one.jsonl").write_text(text)
    r = a.index(root)
    assert (r["new"], r["updated"], r["unchanged"]) == (0, 1, 1)
    now = {r.turn_index: r.msg_id for r in a.show("one").collect()}
    assert len(now) == 6 and {k for k in ids if ids[k] == now[k]} == {0, 1, 3, 4}
    assert a.status()["n_vectors"] == 6 and a.status()["n_messages"] == 8
    found = a.search("penguins", days=10**5)
    assert found.total_matches == 5 and "<mark>penguin</mark>" in found.results[0]["snippet"]
    assert a.search("rocket", days=10**5, embedder=HashEmbedder()).semantic_used
    assert a.list().count() == 2 and a.show("two", "1-1").count() == 1
    with pytest.raises(LookupError):
        a.show("none")
    assert a.reclassify(dry_run=True)["PROCEDURAL"] == (1, 1)
    (p / "two.jsonl").unlink()
    assert a.index(root)["archived"] == 1 and a.index(root, sweep=True)["swept"] == 1 and a.status()["n_sessions"] == 1
    assert a.index(root, rebuild=True)["new"] == 1
    assert a.topics(min_size=2, threshold=0.5)["total_messages_clustered"] <= 6
    assert a.migrate("proj", "moved", "/x", "/y")["n_sessions"] == 1 and a.list(project="MOVED").count() == 1


@pytest.mark.parametrize(
    ("doc", "code"),
    [
        ({"hooks": {"Start": [{"hooks": [{"type": "command", "command": "echo x"}]}]}}, 0),
        ({"hooks": {"Start": [{"type": "command", "command": "echo x"}]}}, 2),
        ({"hooks": {"Start": [{"hooks": [{"type": "command", "command": "bash missing.sh"}]}]}}, 1),
        ({"hooks": {"Start": [{"hooks": [{"type": "other", "command": ""}]}]}}, 2),
        ({"hooks": {"Start": [{"hooks": [{"type": "command", "command": "x", "shell": "fish"}]}]}}, 1),
        ({"hooks": []}, 2),
        ({}, 1),
    ],
)
def test_settings(doc, code):
    assert exit_code(lint(json.dumps(doc), exists=lambda p: False)) == code
    assert exit_code(lint("{")) == 2
