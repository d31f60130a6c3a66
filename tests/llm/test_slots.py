"""What the wrapper's slots, names and forgotten end tags decide."""

import random
import resource
from itertools import combinations

from threadloom.llm import wrapper
from threadloom.llm.wrapper import Wrappers, extract_main_text, induce, main_text, match, parse


def test_names_are_whole_tokens():
    assert main_text('<div class="content no-sidebar"><p>Main text</p></div>') == "Main text"
    assert main_text('<div class="layout with-sidebar"><article><p>Body</p></article></div>') == "Body"
    assert main_text('<div id="search-results-page"><p>Main</p></div>') == "Main"
    assert main_text('<article><div class="entry-header"><h1>Title</h1></div><p>x</p></article>') == "Title\n\nx"
    for name in ("sidebar", "share-buttons", "cookie-notice", "related-posts", "comments", "ad-slot", "widget widget-3"):
        assert main_text(f'<article><p>text</p><div class="{name}"><p>gone</p></div></article>') == "text", name


def test_articles_in_parts_and_forgotten_ends():
    parts = "<main><article><p>Part one, which is longer</p></article><article><p>Part two</p></article></main><aside><article>teaser</article></aside>"
    assert main_text(parts) == "Part one, which is longer\n\nPart two"
    assert main_text("<article><p>before<iframe src=x><p>after</p><svg><path><p>last</p></article>") == "before\n\nafter\n\nlast"
    assert main_text("<article><iframe><p>no frames</p></iframe><svg><text>label</text></svg><p>text</p></article>") == "text"
    deep = "<div>" * 200
    assert main_text(f"<nav>{deep}menu{'</div>' * 200}</nav><article>{deep}deep</div></div>more<div>x</div></article>") == "deepmore\n\nx"


def plain_page(k):
    """No telling tag or name: a list of links, a box that says one of three things, the text, and a box that every page has."""
    r = random.Random(k)
    body = "".join(f"<p>Paragraph {i} of {k}, {r.random()} {r.random()}</p>" for i in range(r.randint(2, 5)))
    links = "".join(f"<a href=x>go to {r.random()}</a>" for _ in range(8))
    return f"<html><body><div class=x1>{links}</div><div class=x2>Wording {k % 3}</div><div class=x3><h1>Title {k}</h1>{body}<p>Read our sister site.</p></div><div class=x4>All rights reserved.</div></body></html>"


def test_slots_decide(spark):
    pages = [plain_page(k) for k in range(60)]
    df = spark.createDataFrame([(k, "http://a.example/x", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    for r in extract_main_text(df).collect():
        assert r.text.startswith(f"Title {r.page_id}\n\nParagraph 0") and "sister" not in r.text and "Wording" not in r.text and "rights" not in r.text and "go to" not in r.text
    assert "sister" in main_text(pages[0])


def test_parts_keep_the_order_of_the_page(spark):
    part = lambda k, i: f"<p>part {i} of {k} {random.Random(f'{k} {i}').random()}</p>"
    pages = [f"<body><nav>x</nav><main><article class=a>{part(k, 0)}</article><article class=a>{part(k, 1)}</article><article class=b>{part(k, 2)}</article></main></body>" for k in range(9)]
    df = spark.createDataFrame([(k, "http://a.example/x", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    for r in extract_main_text(df).collect():
        assert [t.split(" of ")[0] for t in r.text.split("\n\n")] == ["part 0", "part 1", "part 2"]


def brute(a, b):
    """The best match by trying every order-keeping choice of pairs of children."""
    x, y, best = a[4], b[4], 0.0
    for n in range(1, min(len(x), len(y)) + 1):
        for i in combinations(range(len(x)), n):
            for j in combinations(range(len(y)), n):
                if all(x[s][0] == y[t][0] for s, t in zip(i, j)):
                    best = max(best, sum((1.5 if x[s][2] == y[t][2] else 0.5) if x[s][0] == "#text" else brute(x[s], y[t]) + 0.5 * (x[s][1] == y[t][1]) for s, t in zip(i, j)))
    return 1.0 + best


def test_tree_matching_is_the_best():
    r = random.Random(5)

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return ["#text", "", r.choice("ab"), False, []]
        return [r.choice(["p", "div"]), r.choice(["", ".x"]), None, False, [tree(depth - 1) for _ in range(r.randint(0, 3))]]

    for _ in range(150):
        a, b = (["body", "", None, False, [tree(2) for _ in range(r.randint(0, 4))]] for _ in range(2))
        score, pairs = match(a, b)
        assert abs(score - brute(a, b)) < 1e-9
        at = [([id(c) for c in a[4]].index(id(p)), [id(c) for c in b[4]].index(id(q))) for p, q in reversed(pairs)]
        assert all(i < k and j < m for (i, j), (k, m) in zip(at, at[1:]))


def test_many_siblings_stay_bounded():
    for tags in (("p", "p"), ("h2", "p")):
        pages = ["<article>" + "".join(f"<{tags[i % 2]}>{i} of {k}</{tags[i % 2]}>" for i in range(10_000)) + "</article>" for k in range(2)]
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        read, _ = Wrappers([induce(pages)]).read(parse(pages[0]))
        assert len(read) == 10_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10


def test_band_takes_the_diagonal(monkeypatch):
    monkeypatch.setattr(wrapper, "MAX_CELLS", 60)
    kids = [[("p", "div")[i % 2], f".{i}", None, False, [["#text", "", str(i), False, []]]] for i in range(30)]
    score, pairs = match(["body", "", None, False, kids], ["body", "", None, False, kids])
    assert len(pairs) == 30 and all(p is q for p, q in pairs) and score == 1 + 30 * 3.0
