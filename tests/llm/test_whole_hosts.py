"""Template texts are decided by all pages of a host."""

import random

from threadloom.llm.wrapper import extract_main_text, induce, main_text


def article(k, notice, box="div"):
    r = random.Random(k)
    body = "".join(f"<p>Paragraph {i} of {k} {r.random()}</p>" for i in range(r.randint(2, 5)))
    other = "<div class=x><table><tr><td>" if box == "table" else ""
    return f"<html><body><nav>menu</nav>{other}<article><h1>Title {k}</h1>{body}{notice}</article></body></html>"


def extracted(spark, pages):
    df = spark.createDataFrame([(k, "http://a.example/x", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract_main_text(df).collect()}


def test_notice_on_most_pages(spark):
    pages = [article(k, "<p>Read our sister site.</p>" if k % 5 else "") for k in range(60)]
    assert not [k for k, t in extracted(spark, pages).items() if "sister" in t or f"Title {k}" not in t or f"Paragraph 1 of {k}" not in t]


def test_notices_that_take_turns_and_second_layout(spark):
    pages = [article(k, f"<p>Wording {k % 3} of the notice.</p>", "table" if k % 4 == 0 else "div") for k in range(120)]
    assert not [k for k, t in extracted(spark, pages).items() if "Wording" in t or f"Title {k}" not in t]


def test_passage_that_few_pages_repeat_stays(spark):
    pages = [article(k, "<p>A quotation.</p>" if k % 8 == 0 else "") for k in range(80)]
    assert all("A quotation." in t for k, t in extracted(spark, pages).items() if k % 8 == 0)


def test_small_hosts_have_no_template(spark):
    for n in (2, 3):
        pages = [article(k, "<p>A shared passage.</p>") for k in range(n)]
        assert all("A shared passage." in t for t in extracted(spark, pages).values())
        assert "A shared passage." in main_text(pages[0], induce(pages))
