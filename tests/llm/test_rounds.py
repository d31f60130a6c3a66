"""Components by rounds of shuffles, as tables of any size take them."""

import random

import pytest

from threadloom.llm import graph


@pytest.mark.parametrize("few", [0, 25, 1 << 20])
def test_components_by_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(500, 500 + k) for k in range(1, 30)] + [(r.randrange(1000, 1060), r.randrange(1000, 1060)) for _ in range(40)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {x.node: x.comp for x in graph.components(df.where("a <> b")).collect()}
    assert got == {x: find(x) for link in links for x in link if link[0] != link[1]}
