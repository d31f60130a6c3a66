"""Work that has to stay where its rows are, and results that don't change by it."""

import math

import pyarrow as pa
import pytest

from threadloom.functions import stems
from threadloom.operators import fts, search, topics


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts():
    return [(k, " ".join(f"w{(k * j) % 17}" for j in range(k % 11))) for k in range(60)] + [(None, "w1 w1 w2"), (-5, None), (-6, "w3 w3 w3 x")]


def best(texts, queries, top, among=None):
    docs = [(k, (t or "").split()) for k, t in texts]
    total, n = sum(len(t) for _, t in docs), len(docs)
    out = {}
    for q, text in queries:
        found = {}
        for word in set(text.split()):
            df = sum(word in t for _, t in docs)
            idf = math.log((n - df + 0.5) / (df + 0.5)) if df else 0
            for k, t in docs:
                if k is not None and word in t and (among is None or k in among):
                    found[k] = found.get(k, 0) + (idf if idf > 0 else 1e-6) * t.count(word) * 2.2 / (t.count(word) + 1.2 * (0.25 + 0.75 * len(t) * n / total))
        out |= {(q, k): r for r, (s, k) in enumerate(sorted((-round(s, 6), k) for k, s in found.items())[:top], 1)}
    return out


@pytest.mark.parametrize("among", [None, {3, 4, 5, 40}])
def test_batch_scores_stay_where_postings_are(spark, texts, among):
    queries = [(1, "w1 w2 w2 zzz"), (2, "w0 w3 x"), (3, ""), (4, "w0 w5 w9 w16")]
    idx = fts.index(spark.createDataFrame(texts, "msg_id long, content string"), stemmed=False)
    rows = search.search_batch(idx, spark.createDataFrame(queries, "query_id long, text string").hint("broadcast"), 7, among and spark.createDataFrame([(k,) for k in among], "msg_id long"))
    assert {(r.query_id, r.msg_id): r["rank"] for r in rows.collect()} == best(texts, queries, 7, among)
    assert "LeftSemi" in plan(rows).replace(" ", "") and not any("hashpartitioning" in x and "query_id" in x and "msg_id" in x for x in plan(rows).splitlines())
    assert "collect_list" not in plan(rows)


def test_stemming_holds_one_group_of_texts(spark):
    """Neither all rows of an Arrow batch at once, nor two workers a task, as a column function would have."""
    groups = list(stems._groups(pa.array(["x" * 1000] * 9999 + [None])))
    assert sum(len(g) for _, g in groups) == 10000 and [a for a, _ in groups] == [sum(len(g) for _, g in groups[:k]) for k in range(len(groups))]
    assert max(sum(map(len, g)) for _, g in groups) <= stems.GROUP + 1000
    texts = [(k, t) for k, t in enumerate(["Running RUNS", "", None, "Caf\u00e9s \u039f\u0394\u039f\u03a3 \u0130x", "a_b-c 12 \u00bd"] * 7)]
    idx = fts.index(spark.createDataFrame(texts, "msg_id long, content string"))
    assert {r.msg_id: r.dl for r in idx.doc_stats.collect()} == {k: len(stems.terms(t)) for k, t in texts}
    assert {(r.term, r.msg_id): r.positions for r in idx.postings.collect()} == {(w, k): [p for p, x in enumerate(stems.terms(t)) if x == w] for k, t in texts for w in stems.terms(t)}
    found = fts.search_index(idx, "runs OR cafe")
    assert {r.msg_id for r in found.collect()} == {k for k, t in texts if k % 5 in (0, 3)}
    assert "MapInArrow" in plan(found) and "ArrowEvalPython" not in plan(found)


def test_labels_aggregate_by_hash_and_keep_the_order_of_first_use(spark):
    """Ties go by id, then place, also for ids below zero and of 63 bits; a cluster without words and one without an id stay."""
    big = 2**63 - 1
    rows = [(1, -7, "zebra apple zebra apple"), (1, 3, "mango mango"), (2, big, "kiwi"), (2, big - 1, "lemon pears kiwi lemon pears"), (3, 5, "the of"), (3, 6, None), (None, 9, "plum mango")]
    made = topics.labels(spark.createDataFrame(rows, "cluster_id int, msg_id long, content string"))
    steps = plan(made).splitlines()
    assert sum("posexplode" in x for x in steps) == 1 and not any("SortAggregate" in x and "term" in x for x in steps)
    assert {r.cluster_id: r.label for r in made.collect()} == {1: "zebra / apple", 2: "lemon / pears / kiwi", 3: topics.NO_TERMS, None: topics.NO_TERMS}
