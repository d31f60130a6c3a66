from threadloom.llm.wrapper import extract_main_text, induce, main_text

PAGE = """<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home of {k}</a></header><nav><ul><li>menu {k}</li></ul></nav><div class="ad">buy {k}</div><div id="cookie-notice">We use cookies</div>
<{box}><h1>Title &amp; {k}</h1><p>First   paragraph
of <b>page</b> {k}<p>Second &eacute;&#233; {k}<br>line<aside>related {k}</aside><div class="share-buttons">Share</div><p>Read our sister site.</p>
<form><input><button>Go {k}</button></form><ul><li>one {k}</li><li>two {k}</li></ul></{box}>
<section class="comments"><p>reader comment {k}</p></section><aside>side {k}</aside><footer>&copy; {k}</footer></body></html>"""


def page(k, box="article"):
    return PAGE.format(k=k, box=box)


def text(k, sister="\n\nRead our sister site."):
    return f"Title & {k}\n\nFirst paragraph of page {k}\n\nSecond éé {k} line{sister}\n\none {k}\n\ntwo {k}"


def test_article_without_a_wrapper():
    assert main_text(page(1)) == text(1)
    assert main_text(page(2, "main")) == text(2)
    assert main_text(None) == "" and main_text("") == "" and main_text("<p>") == "" and main_text("plain  words") == "plain words"
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<article>cut off <b>in <p>the middle") == "cut off in\n\nthe middle"


def test_template_text_goes():
    w = induce([page(k) for k in range(4)])
    got = main_text(page(9), w)
    assert "sister" not in got and got.startswith("Title & 9")
    assert induce([page(1), page(1)]) is None


def test_slot_without_an_article():
    pages = [page(k, "div class=x").replace("</div class=x>", "</div>") for k in range(5)]
    got = main_text(pages[3], induce(pages))
    assert "First paragraph of page 3" in got and "comment" not in got and "menu" not in got and "©" not in got


def test_pages(spark):
    rows = [(k, "http://a.example/x", page(k)) for k in range(6)] + [(10, "http://b.example", page(10)), (11, None, page(11)), (12, "junk", None), (13, "http://a.example/", ""), (None, "http://c.example", page(3)), (3, "http://a.example/x", page(3))]
    df = spark.createDataFrame([(*r, "w", "h") for r in rows], "page_id long, url string, html string, wrapper string, host string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract_main_text(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    by = dict((i, t) for i, t, _ in got)
    assert by[10] == text(10) and by[11] == text(11) and by[12] == "" and by[13] == "" and by[2] == text(2, "")
    assert extract_main_text(df.limit(0)).count() == 0


def test_copies_of_one_article_keep_their_text():
    same = [page(1).replace("side 1", f"side {k}") for k in range(4)]
    assert main_text(same[0], induce(same)) == text(1)
