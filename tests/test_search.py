import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from threadloom.operators import fts, search

WORDS = "alpha beta gamma delta running runs runner service café box boxes".split()


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 30))) for _ in range(120)] + ["", None]
    rows = [(k + 1, f"s{k % 5}", "user", t, k, None if k % 9 == 0 else f"2024-01-{1 + k % 28:02d}T00:00:00+00:00", ("THOUGHT", "HARNESS", None)[k % 3]) for k, t in enumerate(texts)]
    messages = spark.createDataFrame(rows, "msg_id long, session_id string, role string, content string, turn_index int, timestamp string, content_kind string").cache()
    sessions = spark.createDataFrame([(f"s{k}", f"Proj-{k % 2}", "2024-01-01") for k in range(5)], "session_id string, project_slug string, started_at string")
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(content, tokenize='porter unicode61')")
    db.executemany("insert into t(rowid, content) values (?, ?)", [(a, t or "") for a, _, _, t, *_ in rows])
    idx = fts.index(messages)
    return fts.Index(idx.postings.cache(), idx.doc_stats.cache()), messages, sessions, db


@pytest.mark.parametrize("query", ["alpha", "alpha OR beta", "alpha beta NOT gamma", '"alpha beta"', "alpha + beta", "(alpha AND delta) OR box", "runn* beta", "^gamma", "NEAR(alpha delta, 2)", "service NOT (alpha OR beta)", "content: cafe", "alpha OR alpha", '"running" AND box'])
def test_matches_and_scores_are_those_of_fts5(corpus, query):
    idx, _, _, db = corpus
    want = {r[0]: r[1] for r in db.execute("select rowid, -bm25(t) from t where t match ?", (query,))}
    got = {r.msg_id: r.score for r in fts.search_index(idx, query).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("query", ["", "what?", "foo-bar", "a AND", "(a", "other: x", '"open', "NOT a"])
def test_bad_queries(corpus, query):
    with pytest.raises(fts.QueryError):
        fts.parse_query(query)


def test_fallback_scope_and_formats(corpus):
    idx, messages, sessions, _ = corpus
    r = search.search(idx, messages, sessions, "what about alpha?", days=10**5, limit=3)
    assert r.returned == 3 and r.total_matches > 3 and set(search.RESULT) == set(r.results[0])
    assert search.search(idx, messages, sessions, "zzz", days=9).results == []
    one = search.search(idx, messages, sessions, "alpha OR beta", days=10**5, limit=500, project="PROJ-1", kinds=["THOUGHT"])
    assert {x["project_slug"] for x in one.results} == {"Proj-1"}
    assert json.loads(search.format_response(r, "json"))["returned"] == 3
    assert "additionalContext" in search.format_response(r, "agent-context")
    assert search.format_response(search.Response("q", 0, 0, 0.0, []), "agent-context") == "{}"
    with pytest.raises(fts.QueryError):
        search.search(idx, messages, sessions, "???")


def test_recency_passes_null_times(corpus):
    _, messages, sessions, _ = corpus
    everything = messages.select("msg_id", F.lit(1.0).alias("score"))
    late = search.scoped(everything, messages, sessions, since="2024-01-20").select("timestamp").collect()
    assert any(r[0] is None for r in late) and all(r[0] is None or r[0] >= "2024-01-20" for r in late)


class Client:
    def __init__(self, vector):
        self.vector = vector

    def embed(self, text):
        if self.vector is None:
            raise OSError("down")
        return self.vector


def test_rerank_and_its_failures(corpus, spark):
    idx, messages, sessions, _ = corpus
    plain = search.search(idx, messages, sessions, "alpha", days=10**5, limit=5)
    ids = [r.msg_id for r in fts.search_index(idx, "alpha").orderBy(F.desc("score"), "msg_id").limit(4).collect()]
    v = spark.createDataFrame([(ids[0], [0.0, 1.0]), (ids[2], [1.0, 0.0]), (ids[3], [1.0, 0.0, 0.0])], "msg_id long, vector array<float>")
    r = search.search(idx, messages, sessions, "alpha", days=10**5, limit=5, vectors=v, embedder=Client([1.0, 0.0]))
    assert r.semantic_used and r.results[0]["bm25_rank"] == 2 and r.results[1]["bm25_rank"] == 0 and r.results[2]["bm25_rank"] == 1
    down = search.search(idx, messages, sessions, "alpha", days=10**5, limit=5, vectors=v, embedder=Client(None))
    assert not down.semantic_used and "down" in down.semantic_fallback_reason and [x["turn_index"] for x in down.results] == [x["turn_index"] for x in plain.results]


def test_boost_lifts_the_project_with_most_hits(spark):
    pool = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "a", 2), (4, "b", 3)], "msg_id long, project_slug string, bm25_rank int")
    v = spark.createDataFrame([(1, [0.9, 0.4359]), (4, [0.92, 0.3919])], "msg_id long, vector array<float>")
    order = lambda boost: [r.msg_id for r in search.rerank(pool, v, [1.0, 0.0], boost).orderBy("semantic_rank").collect()]
    assert order(False)[:2] == [4, 1] and order(True)[:2] == [1, 4]


def test_snippet():
    text = " ".join(f"w{k}" for k in range(60)) + " alpha beta end"
    s = fts.snippet(text, [["alpha", "beta"]])
    assert s.startswith("...") and "<mark>alpha beta</mark>" in s and s.endswith("end")
    assert fts.snippet("only few words", [["few"]]) == "only <mark>few</mark> words"
    assert fts.snippet("", [["x"]]) == ""


def test_refresh_equals_a_new_index(corpus, spark):
    idx, messages, _, _ = corpus
    changed = spark.createDataFrame([(1, "omega omega"), (999, "omega")], "msg_id long, content string")
    deleted = spark.createDataFrame([(2,)], "msg_id long")
    new = fts.refresh(idx, changed, deleted)
    rest = messages.where("msg_id not in (1, 2)").select("msg_id", "content").unionByName(changed)
    assert sorted(new.postings.collect()) == sorted(fts.index(rest).postings.collect())


def test_prompt_envelope():
    assert search.prompt_of('{"prompt": "x"}') == "x" and search.prompt_of("no") == "" and search.prompt_of("[1]") == "" and search.prompt_of("{}") == ""
