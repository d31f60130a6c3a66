import re
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import make
from threadloom.llm import line_dedup, ngram_join
from threadloom.llm.graph import components

SPACE = " \t\n\x0b\f\r"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def kept_by_hand(texts, min_chars, min_docs):
    held = defaultdict(list)
    for i, t in texts:
        for k in {lower(x.strip(SPACE)) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(i)
    order = lambda i: (i is not None, i or 0)
    gone = {k: max(v, key=order) for k, v in held.items() if len(v) >= min_docs}
    for i, t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if (k := lower(x.strip(SPACE))) not in gone or gone[k] == i]
        yield i, len(lines), len(lines) - len(keep), "\n".join(keep)


@pytest.mark.parametrize("min_docs", [5, 2])
def test_lines(docs, texts, nothing, min_docs):
    got = line_dedup.drop_lines(docs, min_docs=min_docs)
    assert [c for c in got.columns if c not in ("n_lines", "n_dropped")] == docs.columns
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == Counter(kept_by_hand(texts, 40, min_docs))
    assert line_dedup.drop_lines(nothing).count() == 0


def test_a_hot_line_and_lines_repeated_within_a_row(spark):
    line = "this line is in each and every document, most often more than once"
    rows = [(k, f"{line}\nown {k}\n{line.upper()} " if k % 2 else f"own {k}") for k in range(300)]
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_lines(make(spark, rows)).collect()}
    assert got == {i: (n, t) for i, _, n, t in kept_by_hand(rows, 40, 5)}
    assert got[299][0] == 0 and got[1][0] == 2


def test_bitmaps_are_runs(spark):
    x, y = "x" * 40, "y" * 41
    rows = [(k, f"{x}\n{y}\nkeep\n{x}") for k in range(5)]
    got = {r.doc_id: [tuple(z) for z in r.dropped_runs] for r in line_dedup.drop_bitmaps(make(spark, rows)).collect()}
    assert got == {k: [(0, 2), (3, 1)] for k in range(4)}


def shingled(text, k=4):
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes_by_hand(texts, percent):
    sets = [shingled(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(texts, sets)))


@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates(docs, texts, nothing, percent):
    got = ngram_join.near_duplicates(docs, percent=percent)
    assert Counter(tuple(r) for r in got.collect()) == classes_by_hand(texts, percent)
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_a_large_family_and_a_common_passage(spark):
    import random

    r = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(120)] = f"z{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, passage + " " + " ".join(f"q{k}x{j}" for j in range(r.randint(5, 60)))) for k in range(60)]
    got = ngram_join.near_duplicates(make(spark, rows))
    assert Counter(tuple(x) for x in got.collect()) == classes_by_hand(rows, 85)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (200, 205), (203, 205)], "a long, b long").repartition(5)
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert components(links.limit(0)).count() == 0


